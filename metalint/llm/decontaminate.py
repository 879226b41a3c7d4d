"""Benchmark decontamination: windows of normalised test words, looked for in every training text.

The distinct window hashes of the benchmark are a hash set that is broadcast while it has at most
``BROADCAST_WINDOWS`` entries (8 bytes each); a larger benchmark is joined by shuffle. Each text is scanned once:
all its windows are hashed and only hits leave the scan. Texts with hits are then verified word by word against the
windows themselves, so a hash collision never counts.

Hashing folds case with ``lower`` and then final sigmas to others, as ``lower`` chooses between the two by what
surrounds the word; so hashes never tell apart what folding A-Z holds equal. Verification folds A-Z only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metalint.llm.common import ascii_lower, cut, fresh

WINDOW = 10
BROADCAST_WINDOWS = 2_000_000
WORD_CHARS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are folded.
_CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _words(folded: Column) -> Column:
    return F.array_remove(F.split(folded, _GAP), "")


def _folded_words(text: Column) -> Column:
    """Words for hashing; each character is folded by itself."""
    return _words(F.replace(F.lower(text), F.lit("ς"), F.lit("σ")))


def _hashes(words: Column, m: int) -> Column:
    starts = F.when(F.size(words) >= m, F.sequence(F.lit(1), F.size(words) - m + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, m)))


def _place(at: Column, n: Column, lengths: list[int]) -> Column:
    """First word (from 1) and length of the window at a place in the joined lists of hashes of all lengths."""
    m = lengths[0]
    here = F.struct((at + 1).alias("first"), F.lit(m).alias("m"))
    if len(lengths) == 1:
        return here
    count = F.greatest(n - m + 1, F.lit(0))
    return F.when(at < count, here).otherwise(_place(at - count, n, lengths[1:]))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A side that is broadcast only while its counted rows stay under the bound."""
    return F.broadcast(df) if rows <= BROADCAST_WINDOWS else df


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, m, h, gram): every window of every item; an item of fewer words than WINDOW is one window."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    items = items.select("item_id", _folded_words(F.col("text")).alias("folded"), _words(ascii_lower(F.col("text"))).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("m", F.least(F.size("words"), F.lit(WINDOW)))
    first = items.select("item_id", "m", "folded", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("first"))
    return first.select(
        "item_id", "m", F.xxhash64(F.slice("folded", F.col("first"), F.col("m"))).alias("h"),
        F.array_join(F.slice("words", F.col("first"), F.col("m")), " ").alias("gram"),
    ).distinct()


def verified_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, th, spans, items): the windows that occur in each text and the items they belong to.

    th is the hash of the text; rows with the same doc_id and text are one. spans has (first, m), words from 1.
    """
    windows = cut(benchmark_windows(benchmark))
    rows = windows.count()
    lengths = sorted((r["m"] for r in windows.select("m").distinct().collect()), reverse=True) or [WINDOW]
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))

    split = keyed.select("doc_id", "th", _folded_words(F.col("text")).alias("words"))
    scan = split.select("doc_id", "th", F.size("words").alias("n"), F.concat(*[_hashes(F.col("words"), m) for m in lengths]).alias("hashes"))
    # The outer form: for the inner one Catalyst adds a filter on the list, which would hash every text twice.
    scan = scan.select("doc_id", "th", "n", F.posexplode_outer("hashes").alias("at", "h"))
    hits = scan.join(_small(windows.select("h").distinct(), rows), "h", "left_semi")
    hits = cut(hits.groupBy("doc_id", "th").agg(F.collect_set(_place(F.col("at"), F.col("n"), lengths)).alias("at")))

    hits = hits.toDF("hit_id", "hit_th", "at")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th"))
    found = keyed.join(hits, same).select("doc_id", "th", "at", _words(ascii_lower(F.col("text"))).alias("words"))
    grams = F.transform("at", lambda x: F.struct(
        x["first"].alias("first"), x["m"].alias("m"), F.array_join(F.slice("words", x["first"], x["m"]), " ").alias("gram")))
    found = found.select("doc_id", "th", F.explode(grams).alias("x")).select("doc_id", "th", "x.*")
    items = windows.groupBy("m", "gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    found = found.join(_small(items, rows), ["m", "gram"])
    return cut(found.groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_set(F.struct("first", "m"))).alias("spans"),  # equal rows give the same spans
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ))


def _covered(spans: Column) -> Column:
    """Words inside at least one span; spans are in order."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, zero, lambda acc, x: F.struct(
        F.greatest(acc["end"], x["first"] + x["m"] - 1).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["first"] + x["m"] - 1 - F.greatest(acc["end"], x["first"] - 1))).alias("n"),
    ))["n"]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs (doc_id, text).

    Other columns are not looked at. Nulls and texts without words have none and hit nothing; items without words
    have no window. An item without id counts as a hit but not as an item. Repeated rows give repeated results.
    """
    hits = verified_hits(docs, benchmark).select(
        F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), _covered(F.col("spans")).alias("hit"), "items")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), F.regexp_count(F.lower(text), F.lit(WORD_CHARS + "+")).cast("long").alias("n_words"))
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )




def clean_documents(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """docs without contaminated rows, or (``remove="spans"``) with the hit words taken out of their texts.

    Rows without a hit stay as they are, nulls and repeated rows included.
    """
    of_id, of_text, spans = fresh(docs, "hit_id", "hit_th", "hit_spans")
    hits = verified_hits(docs, benchmark).select(F.col("doc_id").alias(of_id), F.col("th").alias(of_text), F.col("spans").alias(spans))
    key = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(of_text))
    if remove == "documents":
        return docs.join(hits, key, "left_anti")
    gap = _CASED.replace("[^", "[")
    pieces = F.regexp_extract_all("text", F.lit(f"(?s)^{gap}+|{_CASED}+{gap}*"), F.lit(0))
    # What stands before the first word is a piece of its own.
    leads = F.when(F.col("text").rlike(f"^{_CASED}"), F.lit(0)).otherwise(F.lit(1))
    hit = F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["first"], x["first"] + x["m"] - 1))))
    rest = F.filter(pieces, lambda piece, i: ~F.array_contains(hit, i + 1 - leads))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(rest, ""))
    return docs.join(hits, key, "left").select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def contamination_sql() -> str:
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({fold}, '{WORD_CHARS}+')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
        b AS (SELECT item_id, {words} AS w FROM benchmark),
        items AS (SELECT item_id, w, least({WINDOW}, len(w)) AS m FROM b WHERE len(w) > 0),
        g AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS gram
              FROM items, unnest(range(1, len(w) - m + 2)) AS t(i)),
        dw AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS gram
               FROM d, (SELECT DISTINCT m FROM items), unnest(range(1, greatest(len(w) - m + 2, 1))) AS t(i)),
        hit AS (SELECT rid, i, dw.m, item_id FROM dw JOIN g USING (m, gram)),
        covered AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS j FROM hit) GROUP BY rid),
        named AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
                  FROM hit GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""
