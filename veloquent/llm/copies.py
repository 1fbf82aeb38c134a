"""Copies hidden by formatting: a canonical key per text, and a ledger of keys kept up batch by batch."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veloquent import session

LABELS = ("level", "focus", "topic", "say", "pace")
#: what separates words: all but letters and digits, and apostrophes and full stops that are not inside a word
_APART = r"[^\p{L}\p{Nd}'.]+|(?<!\p{L})'|'(?!\p{L})|(?<!\p{Nd})\.|\.(?!\p{Nd})"

_SPACE = " \t\n\r\f\x0b\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def words(text: Column) -> Column:
    """The words of a text in lower case, parted by single spaces; empty if it has none.

    A curly apostrophe counts as a straight one. The patterns repeat single characters only, so texts of
    any length match without recursion.
    """
    plain = F.translate(F.lower(text), "’", "'")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, _APART, " "), " +", " "))


def canonical(text: Column, labels: Sequence[str] = LABELS) -> Column:
    """A string equal for exactly those texts that are the same; null for null and for texts without words.

    Records (JSON objects of strings, or at least two fields ``label: value`` or ``label = value`` parted by
    ``|``, ``;`` or line breaks, all labelled from ``labels``) become their fields in the order of the labels;
    anything else becomes its words. JSON with repeated keys or values other than strings is no record.
    """
    label = rf"(?iU)^\s*({'|'.join(labels)})\s*[:=]"
    pieces = F.filter(F.split(text, r"[|;\r\n]+"), lambda p: p.rlike(r"(?U)\S"))
    fields = F.transform(pieces, lambda p: F.concat(F.lower(F.regexp_extract(p, label, 1)), F.lit("\x02"), words(F.regexp_replace(p, label, ""))))
    is_record = (F.size(pieces) >= 2) & F.forall(pieces, lambda p: p.rlike(label))
    bare = F.btrim(text, F.lit(_SPACE))
    doc = F.when(bare.startswith("{"), F.try_parse_json(bare))
    pairs = F.map_entries(F.try_variant_get(doc, "$", "map<string,variant>"))
    strings = F.forall(pairs, lambda e: F.schema_of_variant(e["value"]) == "STRING")
    json_fields = F.transform(pairs, lambda e: F.concat(F.lower(F.trim(e["key"])), F.lit("\x02"), words(F.try_variant_get(e["value"], "$", "string"))))
    as_record = lambda f: F.concat(F.lit("R"), F.array_join(F.array_sort(f), "\x01"))
    w = words(text)
    return F.when(w == "", F.lit(None)).when(strings & (F.size(pairs) > 0), as_record(json_fields)).when(is_record, as_record(fields)).otherwise(F.concat(F.lit("T"), w))


def keyed(df: DataFrame, origin: str, id_col: str, text_col: str, batch: Column) -> DataFrame:
    """(origin, id, batch, key) of the rows that have an id and a text with words.

    ``key`` is the MD5 of origin and canonical text: 16 bytes travel from here on, never a text.
    """
    c = canonical(F.col(text_col))
    rows = df.select(F.lit(origin).alias("origin"), F.col(id_col).cast("string").alias("id"), batch.alias("batch"), c.alias("_c"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("_c").isNotNull())
    return rows.select("origin", "id", "batch", F.unhex(F.md5(F.concat_ws("\x03", "origin", "_c"))).alias("key"))


class Store:
    """A bucketed table as plain files below a folder, with a list of which file belongs to which bucket.

    Buckets are written through Spark's bucketed tables, so reading them back needs no shuffle; the catalog entry that
    this takes lives only while a table is written or opened. A commit moves the new files in and lists them; files
    that the list does not name are left-overs of a commit that was cut short, and are removed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, buckets: int) -> None:
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path, list(keys), schema, buckets

    def table(self, path: str) -> DataFrame:
        """The bucketed files of a folder."""
        name = f"ledger_{uuid.uuid4().hex}"
        cols = ", ".join(f"`{c}`" for c in self.keys)
        self.spark.sql(f"CREATE TABLE {name} ({self.schema}) USING parquet CLUSTERED BY ({cols}) SORTED BY ({cols}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")  # the files stay

    def write(self, df: DataFrame, path: str) -> dict[int, list[str]]:
        """The rows as bucketed files of a folder; those of each bucket that has rows."""
        name = f"ledger_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).format("parquet").option("path", path).mode("overwrite").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return by_bucket(session.files(self.spark, path))

    def rows(self, files: dict[int, list[str]], only: set[int] | None = None) -> DataFrame:
        """The rows of the given buckets, of all by default. Few buckets are read as files, so that no other is opened."""
        if only is not None and 2 * len(only) < len(files):
            paths = [f"{self.path}/{f}" for b in sorted(only) for f in files.get(b, ())]
            return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return self.table(self.path) if files else self.spark.createDataFrame([], self.schema)

    def take(self, source: str, files: dict[int, list[str]]) -> None:
        """Bring the folder in line with the list: missing files come from ``source``, others go."""
        listed, there = {f for fs in files.values() for f in fs}, set(session.files(self.spark, self.path))
        for f in sorted(listed - there):
            session.move(self.spark, f"{source}/{f}", f"{self.path}/{f}")
        for f in sorted(there - listed):
            session.delete_path(self.spark, f"{self.path}/{f}")
        session.delete_path(self.spark, source)


def by_bucket(names: Sequence[str]) -> dict[int, list[str]]:
    """Data files by the bucket their names tell."""
    out: dict[int, list[str]] = {}
    for f in names:
        if m := re.fullmatch(r"part-.*_(\d{5})\.c\d{3}.*\.parquet", f):
            out.setdefault(int(m.group(1)), []).append(f)
    return out


class Ledger:
    """Per key: origin, number of copies, and the earliest (smallest) id; and the ids that have been counted.

    It lives in a folder and can be opened again by any later session. Each batch has a name: adding one a second
    time changes nothing, nor does a row whose (origin, id) an earlier batch held. A batch is aggregated (combined
    before its shuffle, so a key with any share of the rows costs one row a task) and full-outer-joined with the
    matching buckets; both sides are bucketed, so neither is shuffled, and buckets without a key of the batch are
    neither rewritten nor, if they are the most, read. A batch counts once its commit is listed; one that was cut short
    leaves the ledger as it was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> None:
        self.spark = spark
        self.path = path or session.new_path(spark, "ledger")
        self.state = {"buckets": buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "batches": [], "keys": {}, "ids": {}}
        if "commit.json" in session.files(spark, self.path):
            self.state = json.loads(session.read_bytes(spark, f"{self.path}/commit.json"))
        self.buckets = self.state["buckets"]
        self.keys = Store(spark, f"{self.path}/keys", ["key"], "key binary, origin string, copies bigint, first_id string", self.buckets)
        self.ids = Store(spark, f"{self.path}/ids", ["origin", "id"], "origin string, id string, key binary", self.buckets)
        self._settle()

    def _listed(self, what: str) -> dict[int, list[str]]:
        return {int(b): fs for b, fs in self.state[what].items()}

    def _settle(self) -> None:
        """Finish the last listed commit, should it have been cut short."""
        for store, what in ((self.keys, "keys"), (self.ids, "ids")):
            store.take(f"{self.path}/new-{what}", self._listed(what))

    @property
    def batches(self) -> list[str]:
        return list(self.state["batches"])

    def read(self) -> DataFrame:
        """(key, origin, copies, first_id)"""
        return self.keys.rows(self._listed("keys"))

    def rows(self) -> DataFrame:
        """(origin, id, key) of every row counted."""
        return self.ids.rows(self._listed("ids"))

    def add(self, batch: DataFrame, name: str) -> bool:
        """Add the rows (origin, id, key) of a batch. False if a batch of this name is in the ledger already."""
        if name in self.state["batches"]:
            return False
        keys, ids = self._listed("keys"), self._listed("ids")
        one = batch.repartition(self.buckets, "origin", "id").groupBy("origin", "id").agg(F.min("key").alias("key"))
        if ids:
            one = one.join(self.ids.rows(ids).select("origin", "id"), ["origin", "id"], "left_anti")
        new_ids = self.ids.write(one, f"{self.path}/new-ids")
        fresh = self.ids.table(f"{self.path}/new-ids")
        sums = fresh.groupBy("key").agg(F.min("origin").alias("origin"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
        touched = self.keys.write(sums.repartition(self.buckets, "key"), f"{self.path}/batch")
        if set(touched) & set(keys):
            new, old = self.keys.table(f"{self.path}/batch").alias("new"), self.keys.rows(keys, set(touched)).alias("old")
            if 2 * len(touched) >= len(keys):  # the whole table was opened, for its buckets
                new = new.hint("merge")
            both = old.join(new, F.col("old.key") == F.col("new.key"), "full_outer")
            merged = both.select(
                F.coalesce("old.key", "new.key").alias("key"), F.coalesce("old.origin", "new.origin").alias("origin"),
                (F.coalesce("old.copies", F.lit(0)) + F.coalesce("new.copies", F.lit(0))).alias("copies"),
                F.least("old.first_id", "new.first_id").alias("first_id"),
            )
            if len(touched) < self.buckets:  # the rest of an opened table is not this batch's
                merged = merged.filter(F.pmod(F.hash("key"), F.lit(self.buckets)).isin(sorted(touched)))
            if 2 * len(touched) < len(keys):
                merged = merged.repartition(self.buckets, "key")
            touched = self.keys.write(merged, f"{self.path}/new-keys")
            session.delete_path(self.spark, f"{self.path}/batch")
        else:
            session.delete_path(self.spark, f"{self.path}/new-keys")
            for fs in touched.values():
                for f in fs:
                    session.move(self.spark, f"{self.path}/batch/{f}", f"{self.path}/new-keys/{f}")
        for b, fs in new_ids.items():
            ids.setdefault(b, []).extend(fs)
        self.state |= {"keys": keys | touched, "ids": ids, "batches": [*self.state["batches"], name]}
        session.write_bytes(self.spark, f"{self.path}/commit.json", json.dumps(self.state).encode())
        self._settle()
        return True


def build(spark: SparkSession, rows: DataFrame, path: str | None = None, bucket_rows: int = 500_000) -> Ledger:
    """The ledger of all batches of ``rows`` (as from ``keyed``), new or, with a path, brought up to date.

    Keys are computed in one pass and staged by batch; a bucket of a new ledger has about ``bucket_rows`` rows.
    """
    kept = session.staged(rows.withColumn("batch", F.coalesce("batch", F.lit("none"))), "keys", ("batch",))
    ledger = Ledger(spark, path, min(100_000, max(8, kept.count() // bucket_rows)))
    for (b,) in sorted(kept.select("batch").distinct().collect()):
        ledger.add(kept.filter(F.col("batch") == b), b)
    return ledger


def copies(ledger: Ledger, share: int = 10_000, floor: int = 50_000) -> DataFrame:
    """(origin, first_id, copy_id): every row but the first of each key that has more than one.

    Keys with more than ``1/share`` of the rows are fewer than ``share``, so these are broadcast and their rows
    stay where they are; all other keys meet their rows by a shuffle of the rows.
    """
    kept, many = ledger.rows(), ledger.read().filter(F.col("copies") > 1).select("key", "copies", "first_id")
    most = max(floor, (ledger.read().agg(F.sum("copies")).first()[0] or 0) // share)
    hot = many.filter(F.col("copies") > most).select("key", "first_id")
    found = kept.join(many.filter(F.col("copies") <= most).select("key", "first_id"), "key")
    if hot.head(1):
        found = kept.join(F.broadcast(hot), "key", "left_anti").join(many.filter(F.col("copies") <= most).select("key", "first_id"), "key")
        found = found.unionByName(kept.join(F.broadcast(hot), "key"))
    return found.filter(F.col("id") != F.col("first_id")).select("origin", "first_id", F.col("id").alias("copy_id"))
