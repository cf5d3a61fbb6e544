"""Document fingerprints from closed syncmers, as Spark SQL expressions.

A text's units are its runs of other than white space, cut every 24 characters, and its ideographs one by one; the same for any length.
K - 1 start marks come before them. A window of K units is an anchor if the smallest hash of its inner pairs of units is the first or
the last of them. Whether it is depends on the window alone, so two texts that share a passage share its anchors, wherever it stands
and whatever is around it. Windows that begin with two start marks always are, so the shortest text has an anchor for each unit.
A fingerprint holds the anchors in order, each with its distance from the one before, so every anchor's place is known; two
fingerprints are matched on anchors that follow the one before at the same distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, S, LONGEST = 8, 2, 24
#: A number whose hash with itself is lower than all but one in a million hashes, which makes it the smallest of a window.
START = 1714837
_UNITS = rf"[^\\x20\\x09-\\x0D\\x{{2E80}}-\\x{{10FFFF}}]{{1,{LONGEST}}}|[\\x{{2E80}}-\\x{{10FFFF}}]"
_HASH = 2147483647


def _anchors(units: str) -> str:
    """SQL for the anchors, in order, of an array of unit hashes, start marks included: distance from the anchor before, then 31 bits of hash."""
    inner = K - S + 1
    pairs = f"transform(sequence(0, size({units}) - {S}), i -> xxhash64({', '.join(f'{units}[i + {k}]' for k in range(S))}))"
    least = "least(" + ", ".join(f"p[i + {k}]" for k in range(inner)) + ")"
    chosen = f"filter(sequence(0, size({units}) - {K}), i -> {least} = p[i] or {least} = p[i + {inner - 1}])"
    window = f"xxhash64({', '.join(f'{units}[i + {k}]' for k in range(K))})"
    # One-element arrays bind the pairs' hashes and the chosen places for the lambdas below.
    places = f"transform(array({pairs}), p -> {chosen})"
    made = f"flatten(transform({places}, c -> transform(c, (i, j) -> shiftleft(cast(i - if(j = 0, 0, c[greatest(j - 1, 0)]) as bigint), 31) | ({window} & {_HASH}L))))"
    return f"case when size({units}) < {K} then cast(array() as array<bigint>) else {made} end"


def with_anchors(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with the column `to`: the text's anchors in order (array<bigint>). Without units none; null: null."""
    out = df.withColumn("_units", F.expr(f"concat(array_repeat({START}L, {K - 1}), transform(regexp_extract_all({text}, '{_UNITS}', 0), w -> xxhash64(w)))"))
    return out.withColumn(to, F.when(F.col(text).isNotNull(), F.expr(_anchors("_units")))).drop("_units")


def as_text(anchors: str) -> F.Column:
    """A fingerprint as a string: for each anchor, in hexadecimal digits, its distance from the one before, then eight of hash."""
    return F.expr(f"array_join(transform({anchors}, a -> concat(lower(hex(shiftright(a, 31))), lpad(lower(hex(a & {_HASH}L)), 8, '0'))), ' ')")


def likeness(a: str, b: str) -> F.Column:
    """Jaccard of two fingerprints, 0 to 1: anchors that both have, at the same distance from the one before; two without anchors are alike.

    a, b: names of columns of anchors; split(fingerprint, ' ') does as well.
    """
    return F.expr(
        f"case when {a} is null or {b} is null then 0D when size({a}) = 0 and size({b}) = 0 then 1D "
        f"else size(array_intersect({a}, {b})) / size(array_union({a}, {b})) end"
    )


def next_ids(ids: DataFrame, span: int, bits: int = 8, most: int = 4096) -> DataFrame:
    """(id, next): the next larger id of a table of distinct ids (id) that lie within `span` of each other; of the largest, null.

    Ids meet in buckets of 2**bits numbers; a bucket's last id takes the first of the next bucket that holds any, found in the same
    way, a level up. Levels are added until one has at most `most` rows; that one alone is sorted as a whole.
    """
    levels = 0
    while span >> bits * levels > most:
        levels += 1

    def of(t: DataFrame, level: int) -> DataFrame:  # t: k, first -> k, next: the first of the next larger k
        if level == levels:
            return t.select("k", F.lead("first").over(Window.orderBy("k")).alias("next"))
        t = t.withColumn("b", F.shiftright("k", bits))
        up = of(t.groupBy("b").agg(F.min("first").alias("first")).select(F.col("b").alias("k"), "first"), level + 1)
        inside = t.select("k", "b", F.lead("first").over(Window.partitionBy("b").orderBy("k")).alias("next"))
        return inside.where("next is not null").select("k", "next").unionByName(
            inside.where("next is null").select("k", "b").join(up.select(F.col("k").alias("b"), "next"), "b", "left").select("k", "next")
        )

    return of(ids.select(F.col("id").alias("k"), F.col("id").alias("first")), 0).select(F.col("k").alias("id"), "next")


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text: the last floor(n_chars / 2) characters replaced by the first as many (or all) of the next document's, by
    ascending id, the first after the last. near_*: likeness of fingerprints of the text and the edited, the next one's text.
    Texts that are null, empty or all white space have empty fingerprints; two such are alike. A row with a null id has no next document: its edited
    text ends after the first half, near_next is 0. Where rows repeat an id, each comes back, and the id's smallest text is its text
    for the document before. Other columns are not read. An empty table gives an empty result.
    """
    plain = id_col == "doc_id" and docs.schema["doc_id"].dataType.simpleString() == "bigint"  # an alias would make the two readings differ
    base = docs.select(F.col("doc_id") if plain else F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    ids = base.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    seen = ids.agg(F.min("id"), F.max("n"), F.max("id")).first()
    after = next_ids(ids.select("id"), (seen[2] or 0) - (seen[0] or 0))
    after = cut(after.select(F.col("id").alias("doc_id"), F.coalesce("next", F.lit(seen[0]).cast("long")).alias("next_id")), "next-ids")
    # Both joins read the same rows dealt out by id, so the texts are shuffled once; fingerprints are cheaper to make again than to move.
    known = base.where("doc_id is not null")
    nexts = known if (seen[1] or 0) <= 1 else known.groupBy("doc_id").agg(F.min("text").alias("text"))
    wants = known.select("doc_id", F.expr("cast(floor(length(text) / 2) as int)").alias("want")).groupBy("doc_id").agg(F.max("want").alias("want")).join(after, "doc_id")
    heads = with_anchors(nexts.join(wants.select(F.col("doc_id").alias("before"), F.col("next_id").alias("doc_id"), "want"), "doc_id"), "text", "next_anchors").select(
        F.col("before").alias("doc_id"), F.expr("substring(text, 1, want)").alias("head"), "next_anchors"
    )
    alone = base.where("doc_id is null").withColumns({"head": F.lit(None).cast("string"), "next_anchors": F.lit(None).cast("array<bigint>")})
    joined = with_anchors(known.join(heads, "doc_id").unionByName(alone), "text", "anchors")
    half = "cast(floor(length(text) / 2) as int)"
    edited = joined.withColumn("edited", F.expr(f"concat(substring(text, 1, length(text) - {half}), substring(coalesce(head, ''), 1, {half}))"))
    out = with_anchors(edited, "edited", "edited_anchors")
    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("anchors").alias("fingerprint"),
        as_text("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"),
    )
