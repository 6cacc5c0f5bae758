"""An inverted index that is kept between queries and follows changed entries.

Segments hold the postings of the entries that came with one update, parted by
a hash of the term, the lengths of their fields, written in the same pass, and
marks for the entries that they replace or remove. An entry counts in its latest segment. A version lists the segments in
force and the sums that scores need; a query reads its own terms' parts alone.
Wildcards and edits are looked up among the distinct terms; if they mean more
than MEANT of these, the postings themselves are tried. merge() makes one
segment of all.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.functions.stem import stemmed
from fieldbook.operators import search
from fieldbook.sources.commits import Commits

#: Segments from which an update merges them.
SEGMENTS = 8
#: Terms that wildcards and edits may mean for their parts alone to be read.
MEANT = 1000
#: The part that rows without a term are written to, one for each field of an entry.
LENGTHS = -1
#: Columns of a segment's files; id has the type of the entries' ids.
KINDS = {"postings": "part int, term string, field string, id {}, tf long, n long", "terms": "term string", "lengths": "id {}, field string, n long", "gone": "id {}"}


class Postings:
    """The index in a folder; fields, stop words, stems and parts must be those it was made with. bytewise: a query's edits are of UTF-8 bytes, else of characters."""

    def __init__(self, spark: SparkSession, folder: str, fields: list[str] = search.FIELDS, stop_words: frozenset[str] = search.STOP_WORDS, stem: bool = True, parts: int = 64, bytewise: bool = False):
        self.spark, self.folder, self.fields, self.stop_words, self.stem, self.parts, self.bytewise = spark, folder.rstrip("/"), list(fields), stop_words, stem, parts, bytewise
        self.versions = Commits(spark, f"{self.folder}/_versions")

    def part_of(self, term: Column) -> Column:
        """A number from 0; LENGTHS for a null."""
        return F.when(term.isNull(), LENGTHS).otherwise(F.pmod(F.xxhash64(term), F.lit(self.parts)).cast("int"))

    def _segments(self) -> tuple[list[str], dict]:
        last = self.versions.latest()
        if last is None:
            return [], {}
        self.id_type = last[1]["id_type"]
        return last[1]["segments"], last[1]["sums"]

    def _read(self, kind: str, segments: list[str]) -> DataFrame:
        """What live segments hold of a kind, with the segment's place in their order."""
        schema = KINDS[kind].format(self.id_type) + ", segment string"
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*[f"{self.folder}/{kind}/segment={s}" for s in segments])
        return rows.withColumn("age", F.array_position(F.array(*map(F.lit, segments)), F.col("segment")).cast("int"))

    def _save(self, kind: str, rows: DataFrame, new: str, *parts: str) -> None:
        rows.write.partitionBy(*parts).mode("overwrite").parquet(f"{self.folder}/{kind}/segment={new}")

    def _alive(self, rows: DataFrame, segments: list[str]) -> DataFrame:
        """rows (id, age) whose entry no later segment replaces."""
        if len(segments) == 1:
            return rows
        gone = self._read("gone", segments).groupBy("id").agg(F.max("age").alias("until"))
        return rows.join(gone, (rows.id == gone.id) & (rows.age < gone.until), "left_anti")

    def update(self, documents: DataFrame, removed: DataFrame | None = None) -> None:
        """Take in entries (id, fields), new or changed, one row for each, and leave out removed ones (id)."""
        segments, sums = self._segments()
        if len(segments) >= SEGMENTS:
            self.merge()
            segments, sums = self._segments()
        new, self.id_type = f"s{uuid.uuid4().hex}", documents.schema["id"].dataType.simpleString()
        ids = documents.select("id")
        gone = (ids.unionByName(removed.select("id")) if removed is not None else ids).distinct()
        self._save("gone", gone, new)
        own = F.array(*[F.struct(F.lit(f).alias("field"), search.kept_terms(F.col(f), self.stop_words).alias("terms")) for f in self.fields])
        fields = documents.select("id", F.explode(own).alias("f")).select("id", "f.field", F.size("f.terms").cast("long").alias("n"), "f.terms")
        # An entry is one row, so its terms are counted where they are, and only postings are shuffled. Without
        # outer, Spark infers a filter on the size of what is exploded, which would count for each word again.
        own = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))
        each = search.counted_terms(fields, "terms").select("id", "field", "n", F.explode_outer(F.concat(F.array(own), "counted")).alias("t"))
        self._write(each.select("id", "field", "n", "t.*"), new)
        added = self._sums(self._read("lengths", [new]))
        lost = {}
        if segments:
            marks = self._read("gone", [new]).select("id")
            lost = self._sums(self._alive(self._read("lengths", segments), segments).join(marks, "id", "left_semi"))
        total = {f: [sums.get(f, [0, 0])[k] + added.get(f, [0, 0])[k] - lost.get(f, [0, 0])[k] for k in (0, 1)] for f in self.fields}
        self._commit([*segments, new], total)

    def merge(self) -> None:
        """One segment of all entries that are alive; what it replaces stays on disk for its readers until sweep()."""
        segments, sums = self._segments()
        if len(segments) < 2:
            return
        new = f"s{uuid.uuid4().hex}"
        self._save("gone", self._read("gone", segments).select("id").limit(0), new)
        rows = self._alive(self._read("postings", segments), segments).select("id", "field", "n", "term", "tf")
        lengths = self._alive(self._read("lengths", segments), segments).select("id", "field", "n", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))
        self._write(rows.unionByName(lengths), new, stems=False)
        self._commit([new], sums)

    def sweep(self) -> None:
        """Delete segments that are not in force."""
        live = {f"segment={s}" for s in self._segments()[0]}
        fs, path = self.versions.fs, self.versions.path
        for kind in KINDS:
            for s in fs.listStatus(path(f"{self.folder}/{kind}")):
                if s.isDirectory() and s.getPath().getName() not in live:
                    fs.delete(s.getPath(), True)

    def _write(self, rows: DataFrame, new: str, stems: bool = True) -> None:
        """Save postings, and lengths as rows without a term."""
        if self.stem and stems:
            known = rows.where("term IS NOT NULL").select("term").distinct().withColumn("stem", stemmed("term"))
            rows = rows.join(known, "term", "left").groupBy("id", "field", "n", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
        placed = rows.withColumn("part", self.part_of(F.col("term")))
        # Rebalancing cuts a part that is too large, also within a frequent term, and needs no second pass for its bounds.
        self._save("postings", placed.hint("rebalance", F.col("part")).select("part", "term", "field", "id", "tf", "n"), new, "part")
        fs, own, lengths = self.versions.fs, *map(self.versions.path, (f"{self.folder}/postings/segment={new}/part={LENGTHS}", f"{self.folder}/lengths/segment={new}"))
        if fs.exists(own):
            fs.mkdirs(lengths.getParent())
            fs.rename(own, lengths)
        else:
            fs.mkdirs(lengths)
        self._save("terms", self._read("postings", [new]).select("term").distinct(), new)

    @staticmethod
    def _sums(lengths: DataFrame) -> dict[str, list[int]]:
        """field -> entries and words: one row for each field."""
        return {r.field: [r.docs, r.words] for r in lengths.groupBy("field").agg(F.count("*").alias("docs"), F.sum("n").alias("words")).collect()}

    def _commit(self, segments: list[str], sums: dict) -> None:
        last = self.versions.latest()
        if not self.versions.add(last[0] + 1 if last else 0, {"segments": segments, "sums": sums, "id_type": self.id_type}):
            raise RuntimeError("another writer changed the index; repeat the update")

    def terms(self) -> DataFrame:
        """Distinct terms, also those of entries that were replaced since the last merge."""
        segments, _ = self._segments()
        return self._read("terms", segments).select("term").distinct()

    def lengths(self) -> DataFrame:
        """(id, n): the words of each entry that has any."""
        segments, _ = self._segments()
        return self._alive(self._read("lengths", segments), segments).groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")

    def postings(self, clauses: list[search.Clause]) -> DataFrame:
        """(id, field, term, tf, n) of the terms that clauses mean."""
        segments, _ = self._segments()
        if not segments:
            return self.spark.createDataFrame([], "id string, field string, term string, tf long, n long")
        rows = self._read("postings", segments)
        exact = all("*" not in c.term and not c.edits for c in clauses)
        fits = reduce(Column.__or__, [search.fits_term(c) for c in clauses], F.lit(False))
        wanted = sorted({c.term for c in clauses}) if exact else [r.term for r in self.terms().where(fits).limit(MEANT + 1).collect()]
        if exact or len(wanted) <= MEANT:
            parts = [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "term string").select(self.part_of(F.col("term"))).distinct().collect()] if wanted else []
            fits = F.col("part").isin(parts) & F.col("term").isin(wanted)
        rows = rows.where(fits)
        return self._alive(rows, segments).select("id", "field", "term", "tf", "n")

    def search(self, entries: DataFrame, query: str) -> DataFrame:
        """(id) of the entries that match; a blank query matches all, a broken one none."""
        return search.search(entries, self.postings(self._clauses(query)), query, self.fields, self.stem, self.bytewise)

    def ranked(self, entries: DataFrame, query: str) -> DataFrame:
        """(id, score) of the entries that match."""
        rows = self.postings(self._clauses(query))
        sums = self._segments()[1]
        lengths = self.spark.createDataFrame([(f, *v) for f, v in sums.items()], "field string, docs long, words long")
        scores = search.weighted(rows, lengths, query, self.fields, self.stem, bytewise=self.bytewise)
        return search.search(entries, rows, query, self.fields, self.stem, self.bytewise).join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def _clauses(self, query: str) -> list[search.Clause]:
        try:
            return search.parse(query, self.fields, self.stem, self.bytewise)
        except search.QueryError:
            return []
