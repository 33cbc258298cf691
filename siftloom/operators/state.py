"""Reader state: partial upserts, the offline queue, lists, export and import."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import CHUNK_ROWS, Running, scan

CHANGES_AT_ONCE = 500
CHUNK = 200


def fold(changes: DataFrame) -> DataFrame:
    """One change for each user and item: of each flag the last that isn't null, by seq."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return changes.groupBy("user_email", "item_id").agg(last("read"), last("starred"), F.max("seq").alias("seq"))


def upsert(state: DataFrame, changes: DataFrame, now) -> DataFrame:
    """state (user_email, item_id, is_read, is_starred, updated_at) after changes: null flags leave a column as it is."""
    c = fold(changes).select("user_email", "item_id", F.col("read").cast("int").alias("_r"), F.col("starred").cast("int").alias("_s"), F.lit(True).alias("_c"))
    both = state.join(c, ["user_email", "item_id"], "full_outer")
    return both.select(
        "user_email", "item_id", F.coalesce("_r", "is_read", F.lit(0)).alias("is_read"), F.coalesce("_s", "is_starred", F.lit(0)).alias("is_starred"),
        F.when(F.col("_c"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def read_lists(state: DataFrame) -> DataFrame:
    """Each user's read and starred item ids, sorted."""
    return state.groupBy("user_email").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_read") == 1, F.col("item_id")))).alias("read"), F.array_sort(F.collect_list(F.when(F.col("is_starred") == 1, F.col("item_id")))).alias("starred")
    )


def violations(changes: DataFrame, most: int = CHANGES_AT_ONCE) -> DataFrame:
    """Changes that are not acceptable, and why: too many at once, bad ids, no flag at all. A user's changes are counted by partial
    aggregation and looked up, not gathered."""
    many = changes.groupBy("user_email").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("user_email", F.lit(True).alias("_many"))
    why = F.when(F.col("_many"), "too-many").when(F.coalesce(F.length("item_id"), F.lit(0)).between(1, 512) == F.lit(False), "bad-id").when(F.col("read").isNull() & F.col("starred").isNull(), "no-flag")
    return changes.join(many, "user_email", "left").withColumn("why", why).where("why is not null").drop("_many")


def chunks(pending: DataFrame, size: int = CHUNK, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """pending with the chunk that each change is sent in, by user; seq tells a user's changes apart."""
    placed = scan(pending, ["user_email"], "seq", {"_place": Running("sum", F.lit(1), True)}, chunk_rows)
    return placed.withColumn("chunk", F.floor(F.coalesce("_place", F.lit(0)) / size).cast("int")).drop("_place")


def acknowledge(pending: DataFrame, sent: DataFrame) -> DataFrame:
    """What is still pending: all changes but those sent and not changed since."""
    same = ["user_email", "item_id", "seq"]
    return pending.join(sent.select(*same), same, "left_anti")


def migrate(local: DataFrame, pending: DataFrame) -> DataFrame:
    """Local flags (user_email, item_id, read, starred) that are true and not pending yet, as changes."""
    on = local.where(F.col("read") | F.col("starred"))
    return on.join(pending.select("user_email", "item_id").distinct(), ["user_email", "item_id"], "left_anti")


def of_namespace(state: DataFrame, prefix: str) -> DataFrame:
    """A product's own rows, its prefix taken off; rows of others are left out."""
    return state.where(F.startswith("item_id", F.lit(prefix))).withColumn("item_id", F.expr(f"substring(item_id, {len(prefix) + 1})"))


def export(state: DataFrame, items: DataFrame) -> DataFrame:
    """One JSON text for each user, of the read and starred ids that are on the page."""
    kept = state.join(items.select("item_id").distinct(), "item_id", "left_semi")
    return read_lists(kept).select("user_email", F.to_json(F.struct(F.lit(2).alias("version"), "read", "starred")).alias("json"))


def parse_import(exported: DataFrame) -> DataFrame:
    """(user_email, item_id, flag) of an export; bad ids are skipped, a text of the wrong shape is an error."""
    kind = "version int, read array<string>, starred array<string>"
    got = exported.select("user_email", F.from_json("json", kind).alias("j"))
    ok = F.col("j.starred").isNotNull()
    checked = got.select("user_email", F.when(ok, F.col("j")).otherwise(F.raise_error(F.lit("not an exported state"))).alias("j"))
    both = checked.select("user_email", F.explode(F.concat(F.transform(F.coalesce("j.read", F.array().cast("array<string>")), lambda x: F.struct(x.alias("item_id"), F.lit("read").alias("flag"))), F.transform("j.starred", lambda x: F.struct(x.alias("item_id"), F.lit("starred").alias("flag"))))).alias("x"))
    return both.select("user_email", "x.item_id", "x.flag").where("item_id is not null and item_id <> ''")


def merge_import(current: DataFrame, imported: DataFrame) -> DataFrame:
    """The union of flags, with is_new for those that the import adds."""
    keys = ["user_email", "item_id", "flag"]
    fresh = imported.select(*keys).distinct().join(current.select(*keys), keys, "left_anti").withColumn("is_new", F.lit(True))
    return current.select(*keys).distinct().withColumn("is_new", F.lit(False)).unionByName(fresh)


def replace_with_remote(remote: DataFrame, prefix: str | None = None) -> DataFrame:
    """Local flags (user_email, item_id, flag) as the remote lists (user_email, read, starred) have them: a whole snapshot.

    A product with a prefix takes only its own ids, the prefix taken off; one without takes all.
    """
    lists = [remote.select("user_email", F.explode(flag).alias("item_id"), F.lit(flag).alias("flag")) for flag in ("read", "starred")]
    both = lists[0].unionByName(lists[1])
    return both if prefix is None else of_namespace(both, prefix)


def synchronise(remote: DataFrame, local: DataFrame, pending: DataFrame, migrated: DataFrame, now, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, local flags) after a session began: local flags of users that never migrated join what is pending, all of it is
    written to the remote state, and the remote lists replace what was local.

    remote: state rows. local: user_email, item_id, read, starred. pending: changes. migrated: user_email of those that did.
    """
    first = migrate(local.join(migrated.select("user_email").distinct(), "user_email", "left_anti"), pending)
    on = lambda c: F.when(F.col(c), F.lit(True)).alias(c)
    queued = pending.select("user_email", "seq", "item_id", "read", "starred").unionByName(first.select("user_email", F.lit(0).cast("long").alias("seq"), "item_id", on("read"), on("starred")))
    state = upsert(remote, queued, now)
    return state, replace_with_remote(read_lists(state), prefix)
