"""The trail's tables: append-only Parquet, versions as commits, digests, as-of reads, current state."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import identity
from tracewell.schemas import BOOKKEEPING, BUCKET, COMMIT, DAY_TABLES, GENERATION, GENERATION_TABLES, ID_TABLES, SCHEMAS, SUBJECT_TABLES

CONTENT_TABLES = tuple(t for t in SCHEMAS if t.startswith("features."))
CONTENT = tuple(f.name for f in SCHEMAS["features.credit_applications"] if f.name not in ("ingest_batch_id", "source_row_digest"))


class TrailError(RuntimeError):
    """A claim that the trail can't back."""


class SnapshotTombstonedError(TrailError):
    """The version was erased; it isn't read, not even in part."""


#: A row's digest gives lanes of 24 bits: ten from its own digits and ten from the digest of these.
LANES, LANE_DIGITS = 20, 6
_LANE = 16**LANE_DIGITS


def content_sums(rows: DataFrame, digest: Column, keys: tuple[str, ...] = (), *more: Column) -> DataFrame:
    """(keys, n_rows, lanes, more): a digest of a multiset of rows that adds up.

    Each row's digest is spread over lanes, and lanes are summed modulo 2**24: one partial aggregation, no list and no
    order, whatever the number of rows (up to 2**39). The sums of two multisets give that of their union, and a part can
    be taken away again, so a version's sums follow from those of its commits. They tell changed content from its
    record; they aren't made against someone who may choose the rows to match.
    """
    half = LANES // 2
    two = rows.withColumn("__d", digest).withColumn("__e", identity.sha256(F.col("__d")))
    # two lanes are read at a time, as one number of 48 bits
    pair = lambda i: F.conv(F.substring("__d" if 2 * i < half else "__e", 1 + LANE_DIGITS * (2 * i % half), 2 * LANE_DIGITS), 16, 10).cast("long")
    two = two.withColumns({f"__p{i}": pair(i) for i in range(LANES // 2)})
    lane = lambda i: F.shiftright(f"__p{i // 2}", 24) if i % 2 == 0 else F.col(f"__p{i // 2}").bitwiseAND(_LANE - 1)
    sums = two.groupBy(*keys).agg(F.count("*").alias("n_rows"), *(F.coalesce(F.sum(lane(i)), F.lit(0)).alias(f"__l{i}") for i in range(LANES)), *more)
    return sums.withColumn("lanes", F.array(*(F.col(f"__l{i}") % _LANE for i in range(LANES)))).drop(*(f"__l{i}" for i in range(LANES)))


def added(sums: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n_rows, lanes) of the union of multisets given by their sums; negative ones take rows away."""
    out = sums.groupBy(*keys).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *(F.coalesce(F.sum(F.get("lanes", F.lit(i))), F.lit(0)).alias(f"__l{i}") for i in range(LANES)))
    return out.withColumn("lanes", F.array(*(F.pmod(F.col(f"__l{i}"), F.lit(_LANE)) for i in range(LANES)))).drop(*(f"__l{i}" for i in range(LANES)))


def digest_of(n_rows: Column, lanes: Column) -> Column:
    return identity.sha256(F.concat_ws(":", n_rows.cast("string"), F.transform(lanes, lambda x: x.cast("string"))))


def content_digest(rows: DataFrame, digest: Column, keys: tuple[str, ...] = (), *more: Column) -> DataFrame:
    """(keys, content_digest, row_count, more) of a multiset of rows given by their digests. ``more``: aggregates of the same pass."""
    sums = content_sums(rows, digest, keys, *more)
    return sums.withColumn("content_digest", digest_of(F.col("n_rows"), F.col("lanes"))).withColumnRenamed("n_rows", "row_count").drop("lanes")


def flat_digest(rows: DataFrame, digest: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """The plain form for small sets: the digest of all sorted row digests, one a line."""
    return rows.select(*keys, digest.alias("d")).groupBy(*keys).agg(identity.sha256(F.concat_ws("\n", F.sort_array(F.collect_list("d")))).alias("content_digest"), F.count("*").alias("row_count"))


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row that comes last by ``order``: current state from appended states, one aggregation."""
    row = F.struct(*(F.col(c) for c in events.columns))
    return events.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def new_rows(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet; never an update."""
    return incoming.join(known.select(key), key, "left_anti")


@dataclass
class Trail:
    """The tables under one root folder, for a single writer.

    A commit is a row of the log, written after its data: until then no reader sees these. Files of a subject table lie in
    folders of bucket and generation, the commit that wrote them. An append adds a generation; an erasure writes a bucket
    anew, without some rows, as a generation that replaces those before, and says so in its row of the log. Readers ask
    the log which generations of which buckets are live, as a filter on folders, so they see a table before a commit or
    after it, and fail rather than miss a file that was removed meanwhile.

    ``buckets`` of a new trail should grow with its subject tables, since an erasure writes whole buckets anew.
    """

    spark: SparkSession
    root: str
    buckets: int = 16
    _known: dict = field(default_factory=dict, repr=False)

    def path(self, table: str) -> str:
        return f"{self.root}/{table.replace('.', '/')}"

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, table: str) -> bool:
        fs, p = self._hadoop(self.path(table))
        return fs.exists(p)

    def stored(self, table: str) -> T.StructType:
        extra = [T.StructField(COMMIT, T.LongType())]
        if table in SUBJECT_TABLES or table in ID_TABLES:
            extra.append(T.StructField(BUCKET, T.IntegerType()))
        if table in DAY_TABLES:
            extra.append(T.StructField("day", T.DateType()))
        if table in GENERATION_TABLES:
            extra.append(T.StructField(GENERATION, T.LongType()))
        return T.StructType([*(T.StructField(f.name, f.dataType) for f in SCHEMAS[table]), *extra])

    def bootstrap(self) -> DataFrame:
        """Creates the tables that are missing; (table_identifier, state) with 'created' or 'existing'."""
        made, fresh = [], not self.exists("audit.commits")
        for table in SCHEMAS:
            made.append((table, "existing" if self.exists(table) else "created"))
            if made[-1][1] == "created":
                self.spark.createDataFrame([], self.stored(table)).write.parquet(self.path(table))
        if fresh:
            self._log("*", "layout", 0, [self.buckets])
        return self.spark.createDataFrame(made, "table_identifier string, state string")

    # the log

    def _log(self, table: str, kind: str, n: int, buckets: list[int] | None) -> None:
        row = self.spark.range(1).select(F.lit(table).alias("table_identifier"), F.lit(kind).alias("kind"), F.current_timestamp().alias("at"), F.lit(None if buckets is None else buckets).cast("array<int>").alias("buckets"), F.lit(n).cast("long").alias(COMMIT))
        row.write.mode("append").parquet(self.path("audit.commits"))

    def commit(self, table: str, kind: str, n: int, buckets: list[int] | None = None) -> None:
        """The moment from which readers see commit ``n``: one appended row. ``buckets``: those it writes anew."""
        self._log(table, kind, n, buckets)

    def _commits(self, table: str) -> list:
        """The commits of a table by number, and the layout; asked again only when the log has other files than before."""
        fs, p = self._hadoop(self.path("audit.commits"))
        found = fs.getContentSummary(p)
        state = (found.getFileCount(), found.getLength())
        if self._known.get("state") != state:
            self._known = {"state": state}
        if table not in self._known:
            log = self.spark.read.schema(self.stored("audit.commits")).parquet(self.path("audit.commits"))
            rows = log.where(F.col("table_identifier").isin(table, "*")).select("kind", "buckets", COMMIT).collect()  # a row a commit of the table
            self._known[table] = sorted(rows, key=lambda r: r[COMMIT])
        return self._known[table]

    def n_buckets(self) -> int:
        return next((r.buckets[0] for r in self._commits("*") if r.kind == "layout"), self.buckets)

    def version(self, table: str) -> int:
        """The table's last commit: it also counts erasures, which add no row."""
        return max((r[COMMIT] for r in self._commits(table)), default=0)

    def next_commit(self, table: str) -> int:
        """The number of the next commit. What a commit that broke off left under it is removed."""
        n = (self.spark.read.schema(self.stored("audit.commits")).parquet(self.path("audit.commits")).agg(F.max(COMMIT)).first()[0] or 0) + 1
        for t in {table, "audit.content_sums"} & {*GENERATION_TABLES}:
            self._drop(t, lambda bucket, generation: True, str(n))
        return n

    def replaced(self, table: str) -> dict[int, int]:
        """Of each bucket that was written anew, the generation that did so last."""
        return {b: r[COMMIT] for r in self._commits(table) if r.kind == "erasure" for b in r.buckets or []}

    def _live(self, table: str) -> Column:
        """Whether a file's bucket and generation are part of the table now."""
        first = self.replaced(table)
        live = F.col(GENERATION).isin([r[COMMIT] for r in self._commits(table) if r[COMMIT] > 0] or [0])
        if table not in SUBJECT_TABLES or not first:
            return live
        by = {}
        for b, n in first.items():
            by.setdefault(n, []).append(b)
        stale = [F.col(BUCKET).isin(sorted(own)) & (F.col(GENERATION) < n) for n, own in sorted(by.items())]
        return live & ~reduce(Column.__or__, stale)

    def _drop(self, table: str, gone, generation: str = "*") -> None:
        """Removes the folders of a generation table for which ``gone(bucket, generation)``."""
        fs, _ = self._hadoop(self.path(table))
        inner = f"{BUCKET}=*/{GENERATION}={generation}" if table in SUBJECT_TABLES else f"{GENERATION}={generation}"
        for f in fs.globStatus(self._hadoop(f"{self.path(table)}/{inner}")[1]) or []:
            found = dict(x.split("=") for x in f.getPath().toString().split("/") if x.startswith((f"{BUCKET}=", f"{GENERATION}=")))
            if gone(int(found.get(BUCKET, -1)), int(found[GENERATION])):
                fs.delete(f.getPath(), True)

    def vacuum(self, table: str) -> None:
        """Removes files that no reader sees: of replaced generations, and of commits that broke off. Safe at any time, by the writer."""
        known, first = {r[COMMIT] for r in self._commits(table)}, self.replaced(table)
        self._drop(table, lambda bucket, generation: generation not in known or generation < first.get(bucket, 0))

    # rows

    def raw(self, table: str) -> DataFrame:
        """All that is stored, live or not."""
        return self.spark.read.schema(self.stored(table)).parquet(self.path(table))

    def read(self, table: str) -> DataFrame:
        if table == "audit.content_sums":  # written with the commit of the table that they describe
            known = [r[COMMIT] for t in SUBJECT_TABLES for r in self._commits(t)]
            return self.raw(table).where(F.col(GENERATION).isin(known or [0])).drop(GENERATION)
        return self.raw(table).where(self._live(table)).drop(GENERATION) if table in SUBJECT_TABLES else self.raw(table)

    def current(self, table: str, key: str) -> DataFrame:
        return latest(self.read(table), key, COMMIT)

    def find(self, table: str, key: str, value: str) -> DataFrame:
        """The current state of one key: one row or none. The filter reaches the scan."""
        return latest(self.read(table).where(F.col(key) == value), key, COMMIT)

    def in_buckets(self, table: str, buckets: list[int]) -> DataFrame:
        """The rows of some buckets; no other folder is read."""
        return self.read(table).where(F.col(BUCKET).isin(buckets))

    def buckets_of(self, rows: DataFrame, key: str = "subject_id") -> list[int]:
        """The buckets that may hold the rows' keys: numbers below ``n_buckets``."""
        return sorted(r[0] for r in rows.select(identity.bucket_of(F.col(key), self.n_buckets()).alias("b")).distinct().collect())

    def write(self, table: str, rows: DataFrame, n: int, slices: dict | None = None) -> int:
        """Writes rows under commit ``n``, laid out for reading; returns their number. They are seen once ``n`` is committed.

        Subject tables are laid out by bucket and generation and sorted by subject, decision tables by day and sorted by
        prediction, identities by bucket and sorted, so that lookups and erasures touch few files. ``slices``: into how many
        files, by hash of the prediction, each day is dealt (one for a day without a number), so that a day of any size
        isn't one task's.
        """
        rows, layout, sort = rows.withColumn(COMMIT, F.lit(n).cast("long")) if COMMIT not in rows.columns else rows, [], []
        if table in SUBJECT_TABLES or table in ID_TABLES:
            key = ID_TABLES.get(table, "subject_id")
            rows, layout, sort = rows.withColumn(BUCKET, identity.bucket_of(F.col(key), self.n_buckets())), [BUCKET], [key]
        elif table in DAY_TABLES:
            rows, layout, sort = rows.withColumn("day", F.to_date(DAY_TABLES[table])), ["day"], ["prediction_id"]
        if layout:
            dealt = [F.col(c) for c in layout]
            if slices and max(slices.values()) > 1:
                of_day = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for day, k in slices.items() if k > 1 for x in (day, k))), F.col("day")), F.lit(1))
                dealt.append(F.pmod(F.xxhash64("prediction_id"), of_day))
            rows = rows.repartition(*dealt).sortWithinPartitions(*layout, *sort)
        if table in GENERATION_TABLES:
            rows, layout = rows.withColumn(GENERATION, F.lit(n).cast("long")), [*layout, GENERATION]
        seen = Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*layout)
        if table in ID_TABLES:
            writer = writer.option(f"parquet.bloom.filter.enabled#{ID_TABLES[table]}", "true")
        writer.parquet(self.path(table))
        return seen.get["n"]

    def fitted(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows fitted to the table: columns reordered and cast, absent ones null, a null in a required one an error."""

        def fit(f: T.StructField) -> Column:
            c = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
            return (c if f.nullable else F.coalesce(c, F.raise_error(F.lit(f"{table}.{f.name} is required")).cast(f.dataType))).alias(f.name)

        return rows.select(*map(fit, SCHEMAS[table]))

    def append(self, table: str, rows: DataFrame, slices: dict | None = None) -> int | None:
        """Appends rows as one commit, after they are fitted to the table. Nothing to write is no commit. ``slices``: see ``write``."""
        n = self.next_commit(table)
        if not self.write(table, self.fitted(table, rows), n, *([slices] if slices else [])):
            return None
        if table in CONTENT_TABLES:
            self._describe(table, self.raw(table).where(F.col(GENERATION) == n), n)
        self.commit(table, "append", n)
        return n

    def _describe(self, table: str, rows: DataFrame, n: int, sign: int = 1) -> None:
        """Records the sums of a commit's rows by split; ``sign`` -1 for rows that it takes away."""
        sums = content_sums(rows, identity.row_digest(rows, *CONTENT), ("split",), F.min("as_of_ts").alias("min_as_of_ts"), F.max("as_of_ts").alias("max_as_of_ts"))
        sums = sums.withColumns({"table_identifier": F.lit(table), "n_rows": F.col("n_rows") * sign, "lanes": F.transform("lanes", lambda x: x * sign)})
        self.write("audit.content_sums", self.fitted("audit.content_sums", sums), n)

    def records(self, table: str, records: list[dict]) -> int | None:
        """A few facts from the driver."""
        schema = SCHEMAS[table]
        loose = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        return self.append(table, self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in records], loose))

    # versions

    def as_of(self, table: str, version: int, split: str | None = None) -> DataFrame:
        rows = self.read(table).where(F.col(COMMIT) <= version)
        return rows if split is None else rows.where(F.col("split") == split)

    def recorded_content(self, table: str, version: int, split: str | None = None):
        """(content_digest, row_count, min_as_of_ts, max_as_of_ts) of a version, from the sums of its commits alone.

        Only the times are read again where an erasure took rows away, which no sum can tell.
        """
        sums = self.read("audit.content_sums").where((F.col("table_identifier") == table) & (F.col(COMMIT) <= version))
        sums = sums if split is None else sums.where(F.col("split") == split)
        facts = added(sums).select(digest_of(F.col("n_rows"), F.col("lanes")).alias("content_digest"), F.col("n_rows").alias("row_count"))
        erased = any(r.kind == "erasure" and r[COMMIT] <= version for r in self._commits(table))
        times = (self.as_of(table, version, split).select(F.col("as_of_ts").alias("lo"), F.col("as_of_ts").alias("hi")) if erased else sums.select(F.col("min_as_of_ts").alias("lo"), F.col("max_as_of_ts").alias("hi"))).agg(F.min("lo").alias("min_as_of_ts"), F.max("hi").alias("max_as_of_ts"))
        return facts.join(F.broadcast(times))  # one row each

    def capture(self, table: str, split: str | None = None) -> str:
        """Records the table's current version and returns its identity; again, if it is unchanged, the same one. No row is read."""
        version = self.version(table)
        key = F.lit(f"{table}|{version}|" + ("" if split is None else f"split == '{split}'"))
        record = self.recorded_content(table, version, split).withColumns({
            "data_snapshot_uuid": identity.uuid5(identity.SNAPSHOT_NAMESPACE, key), "table_identifier": F.lit(table), "version": F.lit(version).cast("long"), "captured_at": F.current_timestamp(),
            "split_filter": F.lit(split).cast("string"), "schema_json": F.lit(SCHEMAS[table].json()), "status": F.lit("live"),
        }).persist()
        made = record.first()
        if not made.row_count:
            raise TrailError(f"{table} has no rows to capture")
        known = self.current("audit.data_snapshots", "data_snapshot_uuid").where(F.col("data_snapshot_uuid") == made.data_snapshot_uuid).first()
        if known is None:
            self.append("audit.data_snapshots", record)
        elif known.status == "tombstoned":
            raise SnapshotTombstonedError(f"version {made.data_snapshot_uuid} is being erased; run the erasure again first")
        elif known.content_digest != made.content_digest:
            raise TrailError(f"version {made.data_snapshot_uuid} is recorded with another digest")
        record.unpersist()
        return made.data_snapshot_uuid

    def materialize(self, snapshot_uuid: str, verify: bool = False) -> DataFrame:
        """The rows of a recorded version, all of them; a tombstoned or unknown one is refused."""
        s = self.current("audit.data_snapshots", "data_snapshot_uuid").where(F.col("data_snapshot_uuid") == snapshot_uuid).first()
        if s is None:
            raise TrailError(f"no version {snapshot_uuid}")
        if s.status == "tombstoned":
            raise SnapshotTombstonedError(f"version {snapshot_uuid} is tombstoned")
        rows = self.as_of(s.table_identifier, s.version, s.split_filter)
        if verify and content_digest(rows, identity.row_digest(rows, *CONTENT)).first().content_digest != s.content_digest:
            raise TrailError(f"version {snapshot_uuid} has another digest than its record")
        return rows

    def inventory(self) -> DataFrame:
        """(table_identifier, n_rows, commits) of all tables, in one job."""
        counts = None
        for table in SCHEMAS:
            one = self.read(table).agg(F.count("*").alias("n_rows")).select(F.lit(table).alias("table_identifier"), "n_rows")
            counts = one if counts is None else counts.union(one)
        commits = self.read("audit.commits").groupBy("table_identifier").agg(F.count("*").alias("commits"))
        return counts.join(commits, "table_identifier", "left").fillna(0, ["commits"])


def input_columns() -> tuple[str, ...]:
    return tuple(f.name for f in SCHEMAS["features.credit_applications"] if f.name not in BOOKKEEPING)
