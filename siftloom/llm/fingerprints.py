"""Document fingerprints by closed syncmers. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, let, partitions

SPACES = "[\\x20\\x09-\\x0D]+"


def _edge() -> Column:
    """Stands before the first and after the last word; never the smallest."""
    return F.lit((1 << 63) - 1).cast("long")


def anchors(text: Column, k: int = 3) -> Column:
    """All closed syncmers of k words with inner units of one word, in text order: an array of structs of hash (32 bits) and place,
    the number of the run's first word (from 0; negative where the run begins with edge marks).

    A run of k words is chosen if the smallest hash among its words lies at an edge of the run. That depends on these k
    words alone, so the same words are chosen in any other text. Edge marks stand around the text, so a text of
    fewer words, even of none, has syncmers too. About 2 / k of all runs are chosen.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    hashes = F.transform(F.filter(F.split(text, SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))
    padded = F.concat(F.array_repeat(_edge(), k - 1), hashes, F.array_repeat(_edge(), k - 1))

    def chosen(h: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            rest = [F.get(h, i + j) for j in range(1, k)]
            low = F.least(x, rest[-1])
            inner = F.least(*rest[:-1]) if k > 3 else rest[0] if k == 3 else low
            return F.when(rest[-1].isNotNull() & (low <= inner), F.struct(F.shiftrightunsigned(F.xxhash64(x, *rest), 32).alias("hash"), (i - (k - 1)).alias("place")))

        return F.filter(F.transform(h, one), lambda x: x.isNotNull())

    return let(padded, chosen)


def syncmers(text: Column, k: int = 3) -> Column:
    """The hashes of all anchors, in text order."""
    return anchors(text, k)["hash"]


def likeness(a: Column, b: Column) -> Column:
    """The resemblance of two arrays of syncmer hashes as sets: the share of the union that both have."""
    return let(F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("all")), lambda n: n["both"] / n["all"])


def written(a: Column) -> Column:
    """Anchors as text: of each 8 hex digits of its hash and its place, with spaces between. Nothing is left out, so likenesses and matches can be
    had from two such texts."""
    return F.array_join(F.transform(a, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), 8, "0"), x["place"].cast("string"))), " ")


def read(fingerprint: Column) -> Column:
    """The anchors that a fingerprint was written from."""
    return F.transform(F.split(fingerprint, " "), lambda p: F.struct(F.conv(F.substring(p, 1, 8), 16, 10).cast("long").alias("hash"), F.substring(p, 9, 20).cast("int").alias("place")))


def likeness_of(a: Column, b: Column) -> Column:
    """The likeness of two fingerprints."""
    hashes = lambda f: F.transform(F.split(f, " "), lambda p: F.substring(p, 1, 8))
    return likeness(hashes(a), hashes(b))


def aligned(a: Column, b: Column) -> Column:
    """Positional matching of two arrays of anchors, also under a shift: a struct of shift, the distance of places that most anchors vote for, and
    n, how many anchors both have at that distance.

    Anchors whose hash stands once in each vote: all anchors of both are sorted by hash, where such two are neighbours and alone. Of equal
    numbers the smallest distance counts, and 0 if none votes.
    """
    marked = lambda x, side: F.transform(x, lambda v: F.shiftleft(F.shiftright(v["hash"], 1), 32) + (side << 31) + v["place"] + 64)
    place = lambda v: (v.bitwiseAND(F.lit((1 << 31) - 1))).cast("int")
    same = lambda v, w: F.coalesce(F.shiftright(v, 32) == F.shiftright(w, 32), F.lit(False))
    side = lambda v: F.shiftright(v, 31).bitwiseAND(F.lit(1))

    def distances(s: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            w = F.get(s, i + 1)
            alone = ~same(F.get(s, i - 1), v) & ~same(F.get(s, i + 2), v)
            return F.when((side(v) == 0) & same(v, w) & (side(w) == 1) & alone, place(w) - place(v))

        return F.sort_array(F.filter(F.transform(s, one), lambda d: d.isNotNull()))

    def heaviest(d: Column) -> Column:
        none = F.lit(0)
        start = F.struct(F.lit(None).cast("int").alias("now"), none.alias("run"), none.alias("shift"), none.alias("n"))

        def step(s: Column, x: Column) -> Column:
            run = F.when(s["now"].eqNullSafe(x), s["run"] + 1).otherwise(1)
            return F.struct(x.alias("now"), run.alias("run"), F.when(run > s["n"], x).otherwise(s["shift"]).alias("shift"), F.greatest(run, s["n"]).alias("n"))

        return F.aggregate(d, start, step, lambda s: s["shift"])

    placed = lambda x, by: F.transform(x, lambda v: F.shiftleft(F.shiftright(v["hash"], 1), 32) + (v["place"] + by))
    shift = let(let(F.sort_array(F.concat(marked(a, 0), marked(b, 1))), distances), heaviest)
    return let(shift, lambda by: F.struct(by.alias("shift"), F.size(F.array_intersect(placed(a, by), placed(b, F.lit(0)))).alias("n")))


def next_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """Columns (id, next_id) for each distinct id that isn't null, in ascending order; the first follows the last.

    Only ids are dealt out by range and ordered, each range by itself; the number of ranges bounds what joins them.
    """
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    n = partitions(docs.sparkSession)
    ranged = checkpoint(ids.repartitionByRange(n, "id").withColumn("part", F.spark_partition_id()))
    firsts = [(r[0], r[1]) for r in ranged.groupBy("part").agg(F.min("id")).orderBy("part").collect()]  # a row for each range
    after = {p: firsts[(i + 1) % len(firsts)][1] for i, (p, _) in enumerate(firsts)}
    follow = ranged.withColumn("next_id", F.expr("lead(id) over (partition by part order by id)"))
    if not after:
        return follow.select("id", "next_id")
    first = docs.sparkSession.createDataFrame(list(after.items()), f"part int, first_id {dict(ids.dtypes)['id']}")
    return follow.join(F.broadcast(first), "part").select("id", F.coalesce("next_id", "first_id").alias("next_id"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """Columns (doc_id, text, anchors) for each row: the operator alone. A null text counts as empty."""
    return _texts(docs, id_col, text_col).withColumn("anchors", anchors(F.col("text"), k))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.col(id_col) if id_col == "doc_id" else F.col(id_col).alias("doc_id")
    return docs.select(key, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """Fingerprints of each text, of the text with its second half overwritten by the next document's beginning, and
    how alike these are.

    Columns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, aligned, shift). A
    fingerprint is the text of all its anchors, and the likenesses are those of fingerprints. aligned is how many anchors the edited text
    has at one common distance from where they stood, shift. The next document is that of the next larger id; the first follows the last.

    Hashes have 32 bits: two texts of 1000 anchors without a common run share one by chance in 2.3e-4 of all cases, which changes their
    likeness by 0.0005.

    Anchors take more room than the text, so texts are shuffled and anchors made where they are compared.

    Defined cases: null and empty texts are the same empty text, whose fingerprint is that of edges alone. Rows
    that repeat an id each have a row, all with the same next text; of a next id that repeats, the smallest text is taken. A null id has no next document: its edited text keeps
    its first half only and near_next is 0. In a table of one document, the next is that document.
    """
    # the filter stands below both uses, so that the exchange of texts by id is one and the same
    own = _texts(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    follow = next_ids(docs, id_col)
    right = own.join(follow.select(F.col("next_id").alias("doc_id"), F.col("id").alias("before")), "doc_id")
    right = right.groupBy("doc_id").agg(F.min("before").alias("before"), F.min("text").alias("next_text")).select(F.col("before").alias("doc_id"), "next_text")
    nameless = _texts(docs.where(F.col(id_col).isNull()), id_col, text_col)
    rows = own.join(right, "doc_id", "left").unionByName(nameless, allowMissingColumns=True)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), anchors(F.col("text"), k).alias("anchors"), syncmers(F.col("next_text"), k).alias("next"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "anchors", "next", anchors(F.col("edited"), k).alias("edited_anchors"))
    rows = rows.withColumn("match", aligned(F.col("anchors"), F.col("edited_anchors")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("anchors")).alias("fingerprint"), written(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors.hash"), F.col("edited_anchors.hash")).alias("near_edited"), F.when(F.col("next").isNull(), 0.0).otherwise(likeness(F.col("anchors.hash"), F.col("next"))).alias("near_next"),
        F.col("match.n").cast("long").alias("aligned"), F.col("match.shift").alias("shift"),
    )
