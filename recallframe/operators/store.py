"""The operations log: append, fold, compaction, time travel and the bundle catalogue."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallframe.session import cut

OPS = "seq long, op string, node_id string, text string, metadata string, patch string"
ENTRIES = "node_id string, seq long, text string, metadata string, patches long"
BUNDLE_NAME = re.compile(r"[A-Za-z0-9_.-]{1,64}")


def before_damage(ops: DataFrame) -> DataFrame:
    """Operations before the first damaged one (unknown op or missing id)."""
    bad = F.col("node_id").isNull() | F.col("op").isNull() | ~F.col("op").isin("store", "forget", "update")
    first = ops.where(bad).agg(F.min("seq").alias("cut"))  # one row
    return ops.crossJoin(F.broadcast(first)).where(F.col("cut").isNull() | (F.col("seq") < F.col("cut"))).drop("cut")


_MAP = "map<string,variant>"


def _fields(json: Column) -> Column:
    """JSON text of each field of a JSON object; {} for null and for what is no object."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.transform_values(F.from_json(json, _MAP), lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))), empty)


def _object(fields: Column) -> Column:
    """JSON object of (field, JSON text), fields in order, types as they were."""
    name = lambda k: F.regexp_extract(F.to_json(F.array(k)), "^.(.*).$", 1)
    parts = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(name(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _over(low: Column, high: Column) -> Column:
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.array_contains(F.map_keys(high), k)), high)


def merged(metadata: Column, patches: Column) -> Column:
    """Shallow merge of JSON objects as JSON text, later fields win and keep their types."""
    return _object(F.aggregate(patches, _fields(metadata), lambda acc, p: _over(acc, _fields(p))))


def fold(ops: DataFrame, upto: int | None = None) -> DataFrame:
    """State of the log, also as of ``upto``: node_id, seq, text, metadata (patches merged in), patches (their number).

    A second store of a live id is ignored, forget removes, a later store brings
    the id back, and patches count only after the store that made the entry; the
    last patch of a field wins, fields keep their JSON types.  All steps are aggregates
    with map-side parts and joins that adaptive execution splits, so an id may hold any
    share of the log.
    """
    log = ops if upto is None else ops.where(F.col("seq") <= upto)
    gone = log.where("op = 'forget'").groupBy("node_id").agg(F.max("seq").alias("gone"))
    live = log.where("op <> 'forget'").join(gone, "node_id", "left").where("gone is null or seq > gone").drop("gone")
    born = live.where("op = 'store'").groupBy("node_id").agg(F.min(F.struct("seq", "text", "metadata")).alias("first"))
    entries = born.select("node_id", "first.seq", "first.text", "first.metadata")
    later = live.where("op = 'update'").join(entries.select("node_id", F.col("seq").alias("born")), "node_id").where("seq > born")
    number = later.groupBy("node_id").agg(F.count("*").alias("patches"))
    keys = later.select("node_id", "seq", F.explode(_fields(F.col("patch"))).alias("k", "v")).groupBy("node_id", "k").agg(F.max_by("v", "seq").alias("v"))
    patch = keys.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("patch"))  # one entry per field
    whole = F.when(F.col("patch").isNull(), F.col("metadata")).otherwise(_object(_over(_fields(F.col("metadata")), F.col("patch"))))
    out = entries.join(number, "node_id", "left").join(patch, "node_id", "left")
    return out.select("node_id", "seq", "text", whole.alias("metadata"), F.coalesce("patches", F.lit(0)).alias("patches"))


def as_ops(snapshot: DataFrame) -> DataFrame:
    """Entries of a snapshot as the stores that would make them."""
    none = F.lit(None).cast("string")
    return snapshot.select("seq", F.lit("store").alias("op"), "node_id", "text", "metadata", none.alias("patch"))


def with_tail(snapshot: DataFrame, tail: DataFrame) -> DataFrame:
    """State of a snapshot and the operations behind it."""
    return fold(as_ops(snapshot).unionByName(tail.select("seq", "op", "node_id", "text", "metadata", "patch")))


def changed(ops: DataFrame, cursor: int) -> DataFrame:
    """node_id and the last operation of what was touched behind a cursor: all that a reader must look at again."""
    return ops.where(F.col("seq") > cursor).groupBy("node_id").agg(F.max_by("op", "seq").alias("last_op"), F.max("seq").alias("seq"))


def migrated(rows: DataFrame, id_col: str = "id", text_col: str = "document", metadata_col: str = "metadata") -> DataFrame:
    """text and metadata of another store's rows; their ids go into ``chroma_id``, the source is marked."""
    own = F.create_map(F.lit("chroma_id"), F.to_json(F.to_variant_object(F.array(F.col(id_col).cast("string")))), F.lit("source"), F.lit('"chroma-migration"'))
    mark = F.transform_values(own, lambda k, v: F.when(k == "chroma_id", F.regexp_extract(v, "^.(.*).$", 1)).otherwise(v))
    kept = rows.where(F.trim(text_col) != "")
    return kept.select(F.trim(text_col).alias("text"), _object(_over(_fields(F.col(metadata_col)), mark)).alias("metadata"))


def append_lines(rows: DataFrame, path: str) -> bool:
    """Append JSON lines for an audit; a failure is reported, never raised."""
    try:
        rows.write.mode("append").json(path)
        return True
    except Exception as problem:  # noqa: BLE001 - the audited action has happened already
        logging.getLogger(__name__).warning("audit not written: %s", problem)
        return False


def framed(rows: DataFrame, payload: str) -> DataFrame:
    """The rows with a check number of their payload."""
    return rows.withColumn("crc", F.crc32(F.coalesce(F.col(payload), F.lit("")).cast("binary")))


def torn(rows: DataFrame, payload: str) -> DataFrame:
    """Rows whose check number is missing or does not fit the payload."""
    return rows.where(~F.coalesce(F.col("crc") == F.crc32(F.coalesce(F.col(payload), F.lit("")).cast("binary")), F.lit(False)))


def compact(ops: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Snapshot of the log at ``at``, and the tail that stays."""
    return fold(ops, at), ops.where(F.col("seq") > at)


def due_for_compaction(stats: DataFrame, records: int = 10_000, least_bytes: int = 4 << 20, age_s: int = 3600) -> DataFrame:
    """``due`` for rows of (records, wal_bytes, snapshot_bytes, age_s)."""
    big = F.col("wal_bytes") > F.greatest(F.lit(least_bytes), F.col("snapshot_bytes"))
    return stats.withColumn("due", (F.col("records") > records) | big | ((F.col("age_s") > age_s) & (F.col("records") > 0)))


def recent(entries: DataFrame, n: int, order: str = "seq") -> DataFrame:
    if n <= 0:
        raise ValueError("n must be positive")
    return entries.orderBy(F.desc(order)).limit(n)


SCHEMA_VERSIONS = (1, 2)


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Entries of a saved snapshot and the sequence number it reaches; missing or foreign ones raise."""
    import json

    text = spark.read.text(f"{path}/manifest", wholetext=True).first()
    manifest = json.loads(text[0]) if text else {}
    if manifest.get("schema_version") not in SCHEMA_VERSIONS:
        raise ValueError(f"unknown snapshot version {manifest.get('schema_version')!r}")
    return spark.read.schema(ENTRIES).parquet(f"{path}/entries"), int(manifest.get("seq", 0))


def write_snapshot(entries: DataFrame, path: str, seq: int) -> None:
    """Entries first, then the manifest: a snapshot without one does not count."""
    import json

    entries.select("node_id", "seq", "text", "metadata", "patches").write.mode("overwrite").parquet(f"{path}/entries")
    line = json.dumps({"schema_version": SCHEMA_VERSIONS[-1], "seq": seq})
    entries.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


class MemoryStore:
    """A log and its latest snapshot under one path, partitioned by bundle.

    The state is the snapshot and the operations behind it.  Sequence numbers grow
    but may leave gaps, so a batch of any size is appended without being counted.
    """

    def __init__(self, spark: SparkSession, path: str, bundle: str = "default"):
        if not BUNDLE_NAME.fullmatch(bundle):
            raise ValueError(f"bad bundle name {bundle!r}")
        self.spark, self.path, self.bundle = spark, f"{path}/bundle={bundle}", bundle

    @classmethod
    def load(cls, spark: SparkSession, saved: str, path: str, bundle: str = "default") -> MemoryStore:
        """A store whose first entries are those of a saved snapshot."""
        store = cls(spark, path, bundle)
        entries, seq = read_snapshot(spark, saved)
        write_snapshot(entries, f"{store.path}/snapshot/{seq:020d}", seq)
        return store

    def _folder(self, name: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in files.listStatus(place)) if files.exists(place) else []

    def _snapshot(self) -> tuple[DataFrame, int]:
        held = self._folder("snapshot")
        return read_snapshot(self.spark, f"{self.path}/snapshot/{held[-1]}") if held else (self.spark.createDataFrame([], ENTRIES), 0)

    def ops(self, after: int = 0) -> DataFrame:
        """The log behind a sequence number."""
        log = self.spark.read.schema(OPS).parquet(f"{self.path}/ops") if self._folder("ops") else self.spark.createDataFrame([], OPS)
        return log.where(F.col("seq") > after)

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(f"{self.path}/ops")

    def next_seq(self) -> int:
        _, at = self._snapshot()
        return max(at, self.ops(at).agg(F.max("seq")).first()[0] or 0) + 1

    def append(self, rows: DataFrame) -> int:
        """Store all rows of (text, metadata), blank texts dropped; creates the log if there is none. Returns their number."""
        base = self.next_seq()
        good = cut(rows.where(F.trim("text") != "").select("text", "metadata").withColumn("seq", F.monotonically_increasing_id() + base))
        none = F.lit(None).cast("string")
        good.select("seq", F.lit("store").alias("op"), F.expr("replace(uuid(), '-', '')").alias("node_id"), "text", "metadata", none.alias("patch")).write.mode("append").parquet(f"{self.path}/ops")
        return good.count()

    def store_batch(self, texts: list[str], metadatas: list[str] | None = None) -> list[str]:
        """All or nothing: a blank text or a length mismatch stores nothing."""
        import uuid

        if metadatas is not None and len(metadatas) != len(texts):
            raise ValueError("texts and metadatas differ in length")
        if any(not (t or "").strip() for t in texts):
            raise ValueError("blank text")
        seq, ids = self.next_seq(), [uuid.uuid4().hex for _ in texts]
        if texts:
            self._append([(seq + i, "store", n, t, (metadatas or [None] * len(texts))[i], None) for i, (n, t) in enumerate(zip(ids, texts))])
        return ids

    def store(self, text: str, metadata: str | None = None) -> str:
        return self.store_batch([text], [metadata])[0]

    def entries(self, upto: int | None = None) -> DataFrame:
        """The state, also as of a sequence number not before the latest snapshot."""
        snapshot, at = self._snapshot()
        if upto is not None and upto < at:
            raise ValueError(f"the log before {at} is compacted")
        tail = before_damage(self.ops(at))
        return with_tail(snapshot, tail if upto is None else tail.where(F.col("seq") <= upto))

    def get(self, node_id: str) -> dict | None:
        """The entry with the score of a perfect hit, or None."""
        snapshot, at = self._snapshot()
        only = F.col("node_id") == node_id
        row = with_tail(snapshot.where(only), before_damage(self.ops(at)).where(only)).first()
        return {**row.asDict(), "score": 1.0} if row else None

    def __contains__(self, node_id: str) -> bool:
        return self.get(node_id) is not None

    def __len__(self) -> int:
        return self.entries().count()

    def changed(self, cursor: int) -> DataFrame:
        """What a reader that knows the log up to ``cursor`` must look at again."""
        return changed(self.ops(cursor), cursor)

    def forget(self, node_id: str) -> bool:
        if node_id not in self:
            return False
        self._append([(self.next_seq(), "forget", node_id, None, None, None)])
        return True

    def update_metadata(self, node_id: str, patch: str) -> None:
        if node_id not in self:
            raise KeyError(node_id)
        self._append([(self.next_seq(), "update", node_id, None, None, patch)])

    def compact(self) -> int:
        """Write the state as a snapshot; the log behind it is read from then on."""
        seq = self.next_seq() - 1
        write_snapshot(cut(self.entries()), f"{self.path}/snapshot/{seq:020d}", seq)
        return seq

    def save(self, path: str) -> None:
        write_snapshot(cut(self.entries()), path, self.next_seq() - 1)

    def dump(self, path: str) -> None:
        """JSON lines of the live entries, without vectors."""
        self.entries().select(F.col("node_id").alias("id"), "text", "metadata", F.col("seq").alias("timestamp_step")).write.mode("overwrite").json(path)
