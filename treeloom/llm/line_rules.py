"""Quality rules: base statistics of a text, and cross-document line frequency.

Lines are normalised (stripped, A-Z lower-cased, runs of white space and of
digits made one) and hashed. Within each host a line's distinct documents are
counted; a line above the limits is boilerplate and is removed, and a document
left with too little is rejected.

Rows of a host with equal text are copies of one document and count once; texts
that differ anywhere are different documents. A line is removed when more than
``max_docs`` documents of the host hold it, however often any of them was copied.

All counts are map-side combined; one row per document and line is shuffled, never
a text. Lines meet the common ones of their host by broadcast where their count proves
them small, else in ``SPLITS`` parts of each line, so that a line that a third of all
documents hold is no single task. ``kept_documents`` cuts the lines from the texts, by
broadcast or a join on the row's hash.

Defined results: null text has no words and fails the base rules; a null host is a
host of its own; empty lines are never counted and never cut; repeated rows count as
documents only once per doc_id, text and host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD_SEPARATOR, ascii_lower, broadcast_if_small, carried, let, materialize, row_key, strip

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_DOCS_PER_HOST = 50
MIN_LEFT_PERCENT = 25
#: Parts of a line's documents when the common lines are too many to broadcast.
SPLITS = 16
#: MB of common lines that may be broadcast.
BROADCAST_MB = 32


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATOR, -1), lambda w: w != "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words covered by ``width``-word windows that occur twice or more."""
    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - width
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    def positions(found: Column) -> Column:
        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: F.array_sort(F.transform(F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(positions(found), covered))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count).cast("long")


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed`` added."""
    t = F.coalesce(F.col(text), F.lit(""))
    full = F.filter(F.split(t, "\n", -1), lambda x: strip(x) != "")
    d = docs.withColumn("_words", words_of(F.col(text)))
    d = d.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
    }).drop("_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(strip(line)), WORD_SEPARATOR, " "), "[0-9]+", "0")


def normal_lines(text: Column) -> Column:
    """``normal_line`` of every line with a word, the runs made one in the whole text at once."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09\\x0B-\\x0D]+", " "), "[0-9]+", "0")
    return F.filter(F.transform(F.split(one, "\n", -1), lambda x: ascii_lower(F.btrim(x))), lambda x: x != "")


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def removed_lines(docs: DataFrame, doc_id: str, text: str, host: str, max_docs: int) -> DataFrame:
    """``_ri, _rh, _rs, removed, cut``: of each row with lines above the limits (by id, text
    hash and host) the words in them and their hashes."""
    d = docs.select(*row_key(doc_id, text), F.col(host).cast("string").alias("_host"), normal_lines(F.col(text)).alias("_full"))
    hashed = F.transform("_full", lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))
    d = materialize(d.select("_id", "_h", "_host", hashed.alias("_lines")).dropDuplicates(["_id", "_h", "_host"]), "lines")  # hashes only; read twice
    lines = d.select("_id", "_h", "_host", F.explode("_lines").alias("x")).select("_id", "_h", "_host", "x.*")
    lines = lines.groupBy("_id", "_h", "_host", "h").agg(F.sum("n").alias("n"))
    held = lines.select("_host", "h", "_h").distinct()
    common = held.groupBy("_host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs)
    common = materialize(common.select(F.col("_host").alias("_ch"), F.col("h").alias("_ck")), "common")
    size = common.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("_ch")), F.lit(0)).alias("bytes")).first()
    same = F.col("_host").eqNullSafe(F.col("_ch")) & (F.col("h") == F.col("_ck"))
    if size["rows"] * 64 + size["bytes"] <= BROADCAST_MB << 20:
        hit = lines.join(F.broadcast(common), same)
    else:
        parts = common.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
        hit = lines.join(parts, same & (F.pmod("_h", F.lit(SPLITS)).cast("int") == F.col("_part")))
    cut = hit.groupBy("_id", "_h", "_host").agg(F.sum("n").alias("removed"), F.collect_list("h").alias("cut"))
    return cut.select(F.col("_id").alias("_ri"), F.col("_h").alias("_rh"), F.col("_host").alias("_rs"), "removed", "cut")


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS_PER_HOST, min_words: int = MIN_WORDS, min_left_percent: int = MIN_LEFT_PERCENT, carry: tuple[str, ...] | None = ()) -> DataFrame:
    """Statistics, ``removed_words`` and the verdict ``kept`` of each row, with ``doc``:
    the input columns named by ``carry`` (None: all)."""
    own = [*row_key(doc_id, text), F.col(host).cast("string").alias("_host"), carried(docs, (doc_id, *carry) if carry is not None else None)]
    stats = base_statistics(docs.select(*own, F.col(text).alias("_text")), "_text").drop("_text")
    removed = removed_lines(docs, doc_id, text, host, max_docs)
    d = stats.join(removed, (F.col("_id") == F.col("_ri")) & (F.col("_h") == F.col("_rh")) & F.col("_host").eqNullSafe(F.col("_rs")), "left")
    left = F.col("n_words") - F.coalesce(F.col("removed"), F.lit(0))
    depleted = F.col("removed").isNotNull() & ((left < min_words) | (100 * left < min_left_percent * F.col("n_words")))
    return d.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(F.col("removed"), F.lit(0)).cast("long").alias("removed_words"), (~F.col("base_failed") & ~depleted).alias("kept"), F.col("cut").alias("removed_hashes"))


def without_lines(text: Column, cut: Column) -> Column:
    """The text less the lines whose hashes are in ``cut``; unchanged where that is null."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: (strip(x) == "") | ~F.array_contains(cut, line_hash(x)))
    return F.when(cut.isNull(), text).otherwise(F.array_join(kept, "\n"))


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **options) -> DataFrame:
    """The documents that no rule rejects, with the input's columns; their texts have
    lost the lines above the limits."""
    d = apply_rules(docs, doc_id, text, host, carry=None, **options).where("kept")
    cleaned = without_lines(F.col("doc")[text], F.col("removed_hashes"))
    return d.select(*[(cleaned if c == text else F.col("doc")[c]).alias(c) for c in docs.columns])
