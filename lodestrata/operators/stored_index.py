"""A stored inverted index for ranked search, kept up to date by segments.

Below the index's folder: ``segments/<s>/postings/bucket=<b>`` has (term, id, tf, dl, name) of one version's documents, dealt by the term's hash and sorted by term;
``segments/<s>/documents`` their (id, name, dl); ``segments/<s>/gone`` the ids that the version changed or removed, of which no earlier segment's rows
count; ``manifest`` one row for each version: its segments, the number of live documents and the sum of their lengths.  A version is
visible once its manifest row stands, so a failed update leaves the last one in force.

A search reads the buckets of its terms in each live segment (a posting has its document's length and name), the ids that were changed
since, and one manifest row: not the table of lengths and not the corpus.  An update tokenises the changed documents alone and reads (id, dl) of the live ones once, to
correct the totals.  ``compacted`` merges all segments into one.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.tokens import query_tokens
from lodestrata.operators.search import _ranked, posting_blocks

BUCKETS = 64
#: Frames of one partition each stay partitions of their own in a union, which Spark 4.1 else makes one partition of, and are joined where they are, whatever their size.
_APART = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.maxSinglePartitionBytes": str(2**63 - 1)}


@contextmanager
def _apart(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _APART}
    try:
        for k, v in _APART.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class StoredIndex:
    """The index in a folder, for one dialect; ``ids`` is the Spark type of document ids."""

    def __init__(self, spark: SparkSession, path: str, dialect: str = "ts", buckets: int = BUCKETS, ids: str = "long"):
        self.spark, self.path, self.dialect, self.buckets, self.ids = spark, path.rstrip("/"), dialect, buckets, ids

    # ---- versions
    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def version(self):
        """The newest manifest row: version, segments, n, total; None for an index without documents."""
        if not self._exists(f"{self.path}/manifest"):
            return None
        kind = "version int, segments array<int>, n long, total double"
        return self.spark.read.schema(kind).parquet(f"{self.path}/manifest").orderBy(F.desc("version")).first()

    def _commit(self, version: int, segments: list[int], n: int, total: float) -> None:
        row = self.spark.createDataFrame([(version, segments, n, total)], "version int, segments array<int>, n long, total double")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _table(self, segment: int, name: str) -> DataFrame:
        kind = {"postings": f"term string, id {self.ids}, tf double, dl double, name string, bucket int", "documents": f"id {self.ids}, name string, dl double", "gone": f"id {self.ids}"}[name]
        return self.spark.read.schema(kind).parquet(f"{self.path}/segments/{segment}/{name}").withColumn("segment", F.lit(segment))

    def _all(self, segments, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._table(s, name) for s in segments])

    def _live(self, rows: DataFrame, segments, where_it_is: bool = False) -> DataFrame:
        """Rows (id, segment) that no later segment has changed or removed.  Rows of one partition may be joined where they are, without a shuffle."""
        if len(segments) < 2:
            return rows
        gone = self._all(segments[1:], "gone")
        last = (gone.coalesce(1) if where_it_is else gone).groupBy("id").agg(F.max("segment").alias("since"))
        return rows.join(last.hint("merge") if where_it_is else last, "id", "left").where("since is null or segment >= since").drop("since")

    # ---- updates
    def _bucket(self, term="term"):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, segment: int, docs: DataFrame | None, gone: DataFrame) -> None:
        at = f"{self.path}/segments/{segment}"
        if docs is not None:
            own = F.col("id").cast(self.ids).alias("id")
            blocks = posting_blocks(docs.withColumn("id", own), self.dialect, self._bucket)
            # the bucket deals the rows, one to a task, so each has one file of a segment; terms come apart behind the shuffle
            each = F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("tfs").alias("tf"))).alias("x")
            self._write_postings(segment, blocks.repartitionById(self.buckets, F.col("bucket")).select("id", "dl", "name", "bucket", each).select("x.term", "id", "x.tf", "dl", "name", "bucket"))
            # lengths come back from the postings, so texts are taken apart once; a document without terms has none
            lengths = self._table(segment, "postings").groupBy("id").agg(F.max("dl").alias("dl"))
            documents = docs.select(own, "name").join(lengths, "id", "left").na.fill(0.0, ["dl"])
            documents.write.mode("overwrite").parquet(f"{at}/documents")
        gone.select(F.col("id").cast(self.ids).alias("id")).distinct().write.mode("overwrite").parquet(f"{at}/gone")

    def _write_postings(self, segment: int, rows: DataFrame) -> None:
        """Rows of which each bucket is one partition, sorted by term."""
        rows = rows.select("term", "id", "tf", "dl", "name", "bucket").sortWithinPartitions("bucket", "term", "id")
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/segments/{segment}/postings")

    def upsert(self, docs: DataFrame) -> None:
        """Add documents (id and fields), in place of earlier ones of the same id; an id occurs once."""
        self._update(docs, docs.select("id"))

    def remove(self, ids: DataFrame) -> None:
        """Take documents (id) out."""
        self._update(None, ids.select("id"))

    def _update(self, docs: DataFrame | None, gone: DataFrame) -> None:
        now = self.version()
        segments, n, total, version = (list(now["segments"]), now["n"], now["total"], now["version"]) if now else ([], 0, 0.0, 0)
        segment = version + 1
        self._write(segment, docs, gone)
        held = [s for s in segments if self._exists(f"{self.path}/segments/{s}/documents")]
        if held:
            old = self._live(self._all(held, "documents"), segments).join(self._table(segment, "gone").drop("segment"), "id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0.0)).alias("total")).first()
            n, total = n - old["n"], total - old["total"]
        if docs is not None:
            new = self._table(segment, "documents").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0.0)).alias("total")).first()
            n, total = n + new["n"], total + new["total"]
        self._commit(segment, [*segments, segment], n, float(total))

    def compacted(self) -> None:
        """One segment of all live rows; earlier versions stay readable until their folders are deleted."""
        now = self.version()
        if now is None or len(now["segments"]) < 2:
            return
        segments, segment = list(now["segments"]), now["version"] + 1
        at = f"{self.path}/segments/{segment}"
        held = [s for s in segments if self._exists(f"{self.path}/segments/{s}/documents")]
        if not held:
            return
        self._live(self._all(held, "documents"), segments).select("id", "name", "dl").write.mode("overwrite").parquet(f"{at}/documents")
        # a bucket's files are merged by one task, which joins them with the changed ids where they are: postings are not shuffled
        rows = self._all(held, "postings")
        parts = [self._live(rows.where(F.col("bucket") == b).coalesce(1), segments, where_it_is=True) for b in range(self.buckets)]
        with _apart(self.spark):
            self._write_postings(segment, reduce(DataFrame.unionByName, parts))
        self.spark.createDataFrame([], f"id {self.ids}").write.mode("overwrite").parquet(f"{at}/gone")
        self._commit(segment, [segment], now["n"], now["total"])

    # ---- search
    def postings(self, terms: list[str]) -> DataFrame:
        """Live postings (term, id, tf, dl, name) of terms: their buckets are the only files of postings that are read."""
        now = self.version()
        segments = list(now["segments"]) if now else []
        held = [s for s in segments if self._exists(f"{self.path}/segments/{s}/postings")]
        if not held:
            return self.spark.createDataFrame([], f"term string, id {self.ids}, tf double, dl double, name string")
        asked = self.spark.range(1).select(F.explode(F.lit(list(terms))).alias("term")).select(self._bucket().alias("b")).collect() if terms else []
        rows = self._all(held, "postings").where(F.col("bucket").isin([r["b"] for r in asked]) & F.col("term").isin(*terms))
        return self._live(rows, segments).select("term", "id", "tf", "dl", "name")

    def search(self, query: str, k: int = 50) -> DataFrame:
        """(id, name, score) of the k best documents, as ``search.search`` gives them.

        The rs dialect also takes documents whose name holds the query without having a term of it; for these it reads the names of all documents.
        """
        terms, now = query_tokens(query, self.dialect), self.version()
        if not terms or now is None or not now["n"]:
            return self.spark.createDataFrame([], f"id {self.ids}, name string, score double")
        found = self.postings(terms)
        tf = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(terms)]
        rows = found.groupBy("id").agg(F.first("name").alias("name"), F.first("dl").alias("dl"), *tf)
        have = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.count("*").alias("df")).collect()}  # one row for each term of the query
        if self.dialect == "rs":
            segments = list(now["segments"])
            held = [s for s in segments if self._exists(f"{self.path}/segments/{s}/documents")]
            named = self._live(self._all(held, "documents").where(F.contains(F.lower("name"), F.lit(query.strip().lower()))), segments)
            rows = rows.unionByName(named.join(rows.select("id"), "id", "left_anti").select("id", "name", "dl", *[F.lit(0.0).alias(f"tf{i}") for i in range(len(terms))]))
        stats = {"n": now["n"], "avgdl": now["total"] / now["n"], **{f"df{i}": have.get(t, 0) for i, t in enumerate(terms)}}
        best = _ranked(rows, stats, terms, query, self.dialect, True).orderBy(F.desc("score"), "id").limit(k)
        return best.select("id", "name", F.round("score", 3).alias("score") if self.dialect == "rs" else "score")
