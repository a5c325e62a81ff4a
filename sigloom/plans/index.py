"""A persistent index: Parquet tables and numbered commits.

    <path>/signature/<part>/block=<b>/   (row_index, word_no, bits), sorted; b is row_index >> the part's shift
    <path>/samples/<part>/               (colour, column, sample_name)
    <path>/deletes/<table>/              (part, colour): samples marked as deleted
    <path>/commits/<n>.json              k, m, h, compression, the parts in order and the tables of deletions

Samples of a part that were built from the same sequences share a column of its words; elsewhere each sample has its own, and then column
and colour are one number. A part has whole columns of its samples, numbered from 0; in the index they follow those of the parts before it, so a part is never
rewritten because of its place. A change writes its tables first and its commit last, and takes its commit's number only if no other
writer has it (`commits`); if one has, the change is made again on the newer state, with the tables that it has written. So a reader
sees the index before or after a change, and a writer that ends in between leaves tables that `vacuum` removes.

Reads are pruned: a search asks for some rows, and only the blocks that they are in are listed and read; up to LITERAL_ROWS of them
are also handed to Parquet, which leaves out the pages that hold none. Words of several parts meet only for the rows asked for.

`compact` and `tidy` merge parts; with `purge`, `compact` leaves out deleted samples, and later samples are renumbered.
"""

from __future__ import annotations

import math
import os
import re
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import words
from sigloom.functions.params import chunk_plan
from sigloom.operators import metadata, search, variants
from sigloom.operators import signature as sig
from sigloom.operators.graph import join_spread
from sigloom.plans import commits
from sigloom.plans.config import IndexConfig
from sigloom.plans.stage import staged
from sigloom.sources import bloomfile, cortex, fasta

WORDS = "row_index int, word_no int, bits long"
#: Rows of a search that are written into the plan; IN lists of this length reach Parquet as they are.
LITERAL_ROWS, IN_LIST = 1024, 10
#: Bytes of a block, as estimated from its words, and the most blocks of a part.
BLOCK_BYTES, WORD_BYTES, MOST_BLOCKS = 128 << 20, 12, 4096
#: Parts of about one size that `tidy` makes one of.
FANOUT = 8
TRIES = 20


def _plain(path: str) -> str:
    """A local path as Spark's file column has it, without the scheme."""
    return re.sub("^file:/*", "/", path) if path.startswith("file:") or ":" in path else os.path.abspath(path)


def any_of(column: str, values: list[int]) -> Column:
    """The column has one of the values: IN lists short enough for Parquet, joined by OR in a balanced tree."""
    lists = [F.col(column).isin(values[i : i + IN_LIST]) for i in range(0, len(values), IN_LIST)]
    while len(lists) > 1:
        lists = [reduce(lambda a, b: a | b, lists[i : i + 2]) for i in range(0, len(lists), 2)]
    return lists[0]


def _columns(part: dict) -> int:
    """Columns of a part's words; parts written before samples could share one have as many as samples."""
    return part.get("columns", part["cols"])


class Index:
    def __init__(self, spark: SparkSession, path: str, k: int | None = None, n: int | None = None):
        """The newest state, or that of commit n, of the index in `path`; k, if given, must be that of the index."""
        self.spark, self.path = spark, path.rstrip("/")
        made = commits.numbers(spark, self.path)
        if not made or (n is not None and n not in made):
            raise FileNotFoundError(f"no index in {path}" if not made else f"no commit {n} in {path}")
        self.n = made[-1] if n is None else n
        self.state = commits.read(spark, self.path, self.n)
        self.k, self.m, self.h, self.compression = (self.state[x] for x in ("k", "m", "h", "compression"))
        self.parts: list[dict] = self.state["parts"]
        self.num_cols = sum(p["cols"] for p in self.parts)
        self.num_columns = sum(_columns(p) for p in self.parts)
        if k is not None and k != self.k:
            raise ValueError(f"the index has k={self.k}, not {k}")

    # Reading

    def _first(self, part: dict) -> int:
        """The colour of the part's first sample."""
        return sum(p["cols"] for p in self.parts[: self.parts.index(part)])

    def _first_column(self, part: dict) -> int:
        return sum(_columns(p) for p in self.parts[: self.parts.index(part)])

    def samples(self) -> DataFrame:
        """colour, sample_name, deleted."""
        return self._samples().drop("column")

    def _samples(self) -> DataFrame:
        """colour, column, sample_name, deleted."""
        if not self.parts:
            return self.spark.createDataFrame([], "colour int, column int, sample_name string, deleted boolean")
        name = F.regexp_extract("_metadata.file_path", "/samples/([^/]+)/", 1)
        rows = self.spark.read.schema("colour int, column int, sample_name string").parquet(*(f"{self.path}/samples/{p['name']}" for p in self.parts)).select(name.alias("part"), "colour", F.coalesce("column", "colour").alias("column"), "sample_name")
        places = self.spark.createDataFrame([(p["name"], self._first(p), self._first_column(p)) for p in self.parts], "part string, _first int, _column int")
        gone = self._deleted().withColumn("_gone", F.lit(True))
        # As many places as the commit has parts.
        placed = rows.join(gone, ["part", "colour"], "left").join(F.broadcast(places), "part")
        return placed.select((F.col("colour") + F.col("_first")).cast("int").alias("colour"), (F.col("column") + F.col("_column")).cast("int").alias("column"), "sample_name", F.coalesce("_gone", F.lit(False)).alias("deleted"))

    def _deleted(self) -> DataFrame:
        """part, colour of the deleted samples; a colour counts from its part's first."""
        schema, tables = "part string, colour int", self.state["deletes"]
        if not tables:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/deletes/{t}" for t in tables)).distinct()

    def _scan(self, part: dict, blocks: set[int] | None = None, at: list[int] | None = None) -> DataFrame:
        """The words of a part, in the index's numbering of columns; of the blocks and rows named, if any are."""
        where = f"{self.path}/signature/{part['name']}"
        there = {int(name[6:]) for name in commits.listed(self.spark, where) if name.startswith("block=")}
        if at is not None:
            blocks = {r >> part["shift"] for r in at}
        asked = sorted(there if blocks is None else there & blocks)
        if not asked:
            return self.spark.createDataFrame([], WORDS)
        found = self.spark.read.schema(WORDS).parquet(*(f"{where}/block={b}" for b in asked))
        found = found if at is None else found.where(any_of("row_index", at))
        return sig.shifted(found, self._first_column(part))

    def _merged(self, scans: list[DataFrame]) -> DataFrame:
        if not scans:
            return self.spark.createDataFrame([], WORDS)
        return scans[0] if len(scans) == 1 else sig.compact(reduce(DataFrame.unionByName, scans))

    def _by_colour(self, found: DataFrame, key: str) -> DataFrame:
        """key, word_no, bits of colours from those of columns."""
        if self.num_columns == self.num_cols:
            return found
        bits = words.unpack(found, [key], "column").hint("merge").join(self._samples().select("column", "colour"), "column")
        return words.pack(bits, [key], "colour").select(key, "word_no", "bits")

    def signature(self) -> DataFrame:
        """All words."""
        return self._by_colour(self._signature(), "row_index")

    def _signature(self) -> DataFrame:
        return self._merged([self._scan(p) for p in self.parts])

    def rows(self, asked: DataFrame) -> DataFrame:
        """The words of the rows asked for (row_index), and of no others."""
        return self._by_colour(self._rows(asked), "row_index")

    def _rows(self, asked: DataFrame) -> DataFrame:
        wanted = asked.select("row_index").where("row_index IS NOT NULL").distinct()
        few = [r[0] for r in wanted.limit(LITERAL_ROWS + 1).collect()]
        if not few or not self.parts:
            return self.spark.createDataFrame([], WORDS)
        if len(few) <= LITERAL_ROWS:
            return self._merged([self._scan(p, at=sorted(few)) for p in self.parts])
        # At most MOST_BLOCKS blocks for each of the few shifts that parts have.
        blocks = {s: {r[0] for r in wanted.select(F.shiftright("row_index", s)).distinct().collect()} for s in {p["shift"] for p in self.parts}}
        scans = [self._scan(p, blocks[p["shift"]]) for p in self.parts]
        # One join for all parts; what it leaves is placed by row, so neither the words' union nor a join by row shuffles them again.
        held = reduce(DataFrame.unionByName, scans).join(wanted, "row_index", "left_semi")
        return held if len(scans) == 1 else sig.compact(held)

    def get_rows(self, asked: DataFrame) -> DataFrame:
        """row_index, colour of the rows asked for."""
        return sig.untranspose(self.rows(asked))

    def get_column(self, colour: int) -> DataFrame:
        """row_index, bit for every row; only the part that has the sample is read, and of it one word of each row."""
        if not 0 <= colour < self.num_cols:
            raise ValueError(f"no colour {colour}")
        part = next(p for p in reversed(self.parts) if self._first(p) <= colour)
        column = colour if self.num_columns == self.num_cols else self._samples().where(F.col("colour") == colour).first()["column"]
        return sig.get_column(self._scan(part), column, self.m)

    def num_samples(self) -> int:
        return self.num_cols

    def lookup(self, kmers: DataFrame) -> DataFrame:
        """kmer, word_no, bits of the samples that have all rows of a k-mer; reads the asked rows only."""
        return self._by_colour(self._lookup(kmers), "kmer")

    def _lookup(self, kmers: DataFrame) -> DataFrame:
        # Staged, as both the rows to read and the words that are found ask for it.
        wanted = staged(sig.wanted_rows(kmers, self.h, self.m), "wanted")
        return sig.met_words(wanted, self._rows(wanted))

    def looked_up(self, queries: DataFrame) -> search.Looked:
        """The lookup of a search, by columns."""
        own = staged(search.asked_kmers(queries, self.k), "asked")
        return own, staged(self._lookup(own), "marks")

    def search(self, queries: DataFrame, threshold: float = 1.0, score: bool = False) -> DataFrame:
        return search.search(queries, None, self._samples(), self.k, self.h, self.m, threshold, score, looked=self.looked_up(queries))

    def search_one(self, seq: str, threshold: float = 1.0, score: bool = False) -> list[dict]:
        """The hits of one sequence, best first, as dictionaries."""
        queries = self.spark.createDataFrame([(0, seq)], "query_id long, seq string")
        search.warn_short(queries, self.k)
        rows = search.ordered(self.search(queries, threshold, score)).drop("query_id", "colour").collect()
        return [r.asDict() for r in rows]

    def variant_search(self, probes: DataFrame) -> DataFrame:
        return variants.of_hits(self.search(variants.as_queries(probes)))

    # Writing

    @staticmethod
    def _shift(m: int, n_words: int) -> int:
        """Rows of a block, as a power of two, such that a block of so many words has about BLOCK_BYTES."""
        blocks = min(MOST_BLOCKS, max(1, math.ceil(n_words * WORD_BYTES / BLOCK_BYTES)))
        return math.ceil(m / blocks - 1).bit_length() if m > 1 else 0

    @staticmethod
    def _write(spark: SparkSession, path: str, m: int, compression: str, signature: DataFrame, samples: DataFrame, cols: int, columns: int, most_words: int) -> dict:
        """Writes a part: words and samples (colour, column, sample_name) that count from 0, and at most so many words."""
        name, shift = uuid.uuid4().hex, Index._shift(m, most_words)
        blocked = signature.select("row_index", "word_no", "bits", F.shiftright("row_index", shift).alias("block"))
        in_order = blocked.repartitionByRange("row_index").sortWithinPartitions("block", "row_index", "word_no")
        in_order.write.option("compression", compression).partitionBy("block").parquet(f"{path}/signature/{name}")
        samples.select("colour", "column", "sample_name").write.parquet(f"{path}/samples/{name}")
        return {"name": name, "cols": cols, "columns": columns, "shift": shift, "words": most_words}

    @staticmethod
    def build(spark: SparkSession, config: IndexConfig, bloom: DataFrame, names: DataFrame, order: list[str] | None = None) -> Index:
        """From (sample_name, row_index) and the samples' names; colours follow `order`, else the names.

        With `max_build_bytes` the columns are built in chunks of samples that fit by the memory model, a part of the index each.
        Names may come with `lead`, the name of the sample whose filter they have; `bloom` then has the leads' filters only.
        """
        metadata.validate(names)
        path = config.path.rstrip("/")
        if commits.numbers(spark, path):
            raise FileExistsError(f"there is an index in {path}")
        led = "lead" in names.columns
        samples = staged(metadata.assign(names, order or ["sample_name"], keep=["lead"] if led else None), "samples")
        known = bloom.agg(F.min("row_index").alias("a"), F.max("row_index").alias("b"), F.count("*").alias("n")).first()
        if known["n"] and (known["a"] < 0 or known["b"] >= config.m):
            raise ValueError(f"filters of more than {config.m} bits")
        n = metadata.count(samples)
        size = n
        if config.max_build_bytes and n:
            size, _ = chunk_plan(n, config.m, config.max_build_bytes)
            if size < 1:
                raise ValueError("max_build_bytes does not hold one filter")
        size = max(size, 1)
        samples = samples.withColumn("_chunk", F.floor(F.col("colour") / size))
        if led:  # the filters of each chunk, in the order of the first samples that have them
            first = samples.groupBy("_chunk", F.col("lead").alias("sample_name")).agg(F.min("colour").alias("_least"))
            filters = staged(metadata.assign(first, ["_least"], keep=["_chunk"]).select(F.col("colour").alias("_filter"), "sample_name", "_chunk"), "filters")
            samples = samples.join(filters.select("_chunk", F.col("sample_name").alias("lead"), "_filter"), ["_chunk", "lead"])
        else:
            samples = samples.withColumn("_filter", F.col("colour"))
            filters = samples.select("_filter", "sample_name", "_chunk")
        # As many rows as the index gets parts.
        places = {r["_chunk"]: (r["first"], r["n"]) for r in filters.groupBy("_chunk").agg(F.min("_filter").alias("first"), F.count("*").alias("n")).collect()}
        many = max(filters.select("sample_name").distinct().count(), 1) if led else n
        coloured = bloom.join(filters, "sample_name").select("row_index", "_filter", "_chunk")
        if size < n:
            coloured = staged(coloured, "coloured")
        parts = []
        for lo in range(0, n, size):
            first, columns = places[lo // size]
            own = F.col("_chunk") == lo // size
            chunk = (coloured.where(own) if size < n else coloured).select("row_index", (F.col("_filter") - first).cast("int").alias("colour"))
            bits = min(math.ceil(known["n"] * columns / many), config.m * math.ceil(columns / 64))
            numbered = samples.where(own).select((F.col("colour") - lo).cast("int").alias("colour"), (F.col("_filter") - first).cast("int").alias("column"), "sample_name")
            parts.append(Index._write(spark, path, config.m, config.compression, sig.transpose(chunk), numbered, min(size, n - lo), columns, bits))
        try:
            commits.write(spark, path, 0, {"k": config.k, "m": config.m, "h": config.h, "compression": config.compression, "parts": parts, "deletes": []})
        except commits.Conflict as other:
            raise FileExistsError(f"there is an index in {path}") from other
        return Index(spark, path)

    @staticmethod
    def build_sequences(spark: SparkSession, config: IndexConfig, seqs: DataFrame, order: list[str] | None = None) -> Index:
        """From (sample_name, seq); a sample may have many sequences. Samples of the same sequences share a filter."""
        leads = search.shared(seqs, "sample_name", "lead")
        own = seqs.join(leads.where("sample_name = lead").select("sample_name"), "sample_name", "left_semi")
        bloom = sig.bloom_of_sequences(own, "sample_name", "seq", config.k, config.h, config.m)
        names = seqs.select("sample_name", *(order or [])).distinct()
        return Index.build(spark, config, staged(bloom, "bloom"), names.join(leads.withColumnRenamed("sample_name", "_name"), F.col("sample_name").eqNullSafe(F.col("_name"))).drop("_name"), order)

    @staticmethod
    def build_files(spark: SparkSession, config: IndexConfig, manifest: str | None = None, paths: list[str] | None = None, samples: list[str] | None = None) -> Index:
        """From filter files (.bloom), graphs (.ctx) or FASTA files: of a manifest (path, tab, sample name), or as a list; one of the two.

        Names default to the paths; a relative path of a manifest is one beside the manifest. Colours follow the order given.
        """
        if (manifest is None) == (paths is None):
            raise ValueError("a manifest or a list of files, and not both")
        if manifest is not None:
            rows = fasta.read_manifest(spark, manifest).orderBy("n").collect()
            base = manifest.rpartition("/")[0]
            paths = [r["path"] if ":" in r["path"] or r["path"].startswith("/") or not base else f"{base}/{r['path']}" for r in rows]
            samples = [r["sample_name"] for r in rows]
        samples = samples or paths
        if len(samples) != len(paths):
            raise ValueError("as many sample names as files")
        named = spark.createDataFrame([(i, _plain(p), s) for i, (p, s) in enumerate(zip(paths, samples, strict=True))], "n long, path string, sample_name string")
        kinds: dict[str, list[str]] = {}
        for p in paths:
            kinds.setdefault(p.rpartition(".")[2] if p.rpartition(".")[2] in ("bloom", "ctx") else "fasta", []).append(p)
        found = []
        if "bloom" in kinds:
            found.append(bloomfile.read_filters(spark, kinds["bloom"], config.m))
        if "ctx" in kinds:
            kmers = cortex.graph_kmers(cortex.read_graph(spark, kinds["ctx"]), config.k)
            found.append(sig.bloom_of_kmers(kmers, "path", config.h, config.m))
        if "fasta" in kinds:
            found.append(sig.bloom_of_sequences(fasta.read_sequences(spark, kinds["fasta"]), "path", "seq", config.k, config.h, config.m))
        bloom = found[0]
        for more in found[1:]:
            bloom = bloom.unionByName(more)
        bloom = bloom.withColumn("path", F.regexp_replace("path", "^file:/*", "/")).join(named, "path").select("sample_name", "row_index")
        return Index.build(spark, config, staged(bloom, "bloom"), named.select("sample_name", "n"), ["n"])

    def _change(self, made: Callable[[Index], dict]) -> Index:
        """Commits what `made` changes of the state, made again on the newest state as long as other writers come first."""
        base = self
        for _ in range(TRIES):
            state = base.state | made(base)
            try:
                commits.write(self.spark, self.path, base.n + 1, state)
                return Index(self.spark, self.path, n=base.n + 1)
            except commits.Conflict:
                base = Index(self.spark, self.path)
        raise commits.Conflict(f"{TRIES} other changes of {self.path} came first")

    def insert(self, bloom: DataFrame, name: str) -> Index:
        """One more sample from its set rows (row_index); rows beyond the filter's size are padding."""
        new = self.spark.createDataFrame([(0, name)], "colour int, sample_name string")
        metadata.validate(new, self.samples())
        column = staged(bloom.where((F.col("row_index") >= 0) & (F.col("row_index") < self.m)).select("row_index", F.lit(0).alias("colour")).distinct(), "column")
        part = self._write(self.spark, self.path, self.m, self.compression, sig.transpose(column), new.withColumn("column", F.lit(0)), 1, 1, column.count())

        def made(base: Index) -> dict:
            if base.n != self.n:
                metadata.validate(new, base.samples())
            return {"parts": [*base.parts, part]}

        return self._change(made)

    def merge(self, other: Index) -> Index:
        """Other's samples after the own ones; both need equal k, m and h."""
        if (self.k, self.m, self.h) != (other.k, other.m, other.h):
            raise ValueError("indexes with different k, m or h")
        theirs, written = other._samples(), {}

        def made(base: Index) -> dict:
            both = metadata.merge(base.samples(), theirs, base.num_cols).where(F.col("colour") >= base.num_cols)
            moved = staged(both.withColumn("colour", (F.col("colour") - base.num_cols).cast("int")).join(theirs.select("colour", "column"), "colour"), "moved")
            if not written:
                written.update(self._write(self.spark, self.path, self.m, self.compression, other._signature(), moved, other.num_cols, other.num_columns, sum(p["words"] for p in other.parts)))
            else:  # other names may be taken by now
                moved.select("colour", "column", "sample_name").write.mode("overwrite").parquet(f"{self.path}/samples/{written['name']}")
            gone = moved.where("deleted").select(F.lit(written["name"]).alias("part"), "colour")
            return {"parts": [*base.parts, dict(written)], "deletes": [*base.state["deletes"], *self._marked(gone)]}

        return self._change(made)

    def _marked(self, gone: DataFrame) -> list[str]:
        """Writes (part, colour) as a table of deletions; none for no rows."""
        if gone.isEmpty():
            return []
        table = uuid.uuid4().hex
        gone.select("part", "colour").coalesce(1).write.parquet(f"{self.path}/deletes/{table}")
        return [table]

    def delete_sample(self, name: str) -> Index:
        """Marks a sample; its name stays taken and its column in place until a `compact` that purges."""
        return self.delete_samples(self.spark.createDataFrame([(name,)], "sample_name string"))

    def delete_samples(self, names: DataFrame) -> Index:
        """Marks the samples of a table of names (sample_name) in one change; every one must be there."""
        wanted = names.select("sample_name").distinct()

        def made(base: Index) -> dict:
            live = staged(base.samples().where(~F.col("deleted")).select("colour", "sample_name").join(wanted, "sample_name", "right"), "gone")
            missing = live.where("colour IS NULL").limit(1).collect()
            if missing:
                raise ValueError(f"no sample {missing[0]['sample_name']!r}")
            places = self.spark.createDataFrame([(p["name"], base._first(p), base._first(p) + p["cols"]) for p in base.parts], "part string, lo int, hi int")
            # As many places as the commit has parts.
            gone = live.join(F.broadcast(places), (F.col("colour") >= F.col("lo")) & (F.col("colour") < F.col("hi"))).select("part", (F.col("colour") - F.col("lo")).alias("colour"))
            return {"deletes": [*base.state["deletes"], *self._marked(gone)]}

        return self._change(made)

    # Maintenance

    def _own(self, run: list[dict]) -> DataFrame:
        """The samples of adjacent parts, counted from the first one's."""
        first, cols = self._first(run[0]), sum(p["cols"] for p in run)
        own = self._samples().where((F.col("colour") >= first) & (F.col("colour") < first + cols))
        return own.withColumns({"colour": (F.col("colour") - first).cast("int"), "column": (F.col("column") - self._first_column(run[0])).cast("int")})

    def _one_of(self, run: list[dict]) -> tuple[dict, list[str]]:
        """Writes one part for adjacent ones; also the tables of deletions that then hold."""
        own = staged(self._own(run), "own")
        merged = sig.compact(reduce(DataFrame.unionByName, [sig.shifted(self._scan(p), -self._first_column(run[0])) for p in run]))
        part = self._write(self.spark, self.path, self.m, self.compression, merged, own, sum(p["cols"] for p in run), sum(_columns(p) for p in run), sum(p["words"] for p in run))
        others = self._deleted().where(~F.col("part").isin([p["name"] for p in run]))
        return part, self._marked(others.unionByName(own.where("deleted").select(F.lit(part["name"]).alias("part"), "colour")))

    def _purged(self) -> dict:
        """Writes one part with the samples that are not deleted; they keep their order."""
        live = self._samples().where(~F.col("deleted")).select(F.col("colour").alias("_was"), F.col("column").alias("was"), "sample_name")
        numbered = staged(metadata.assign(live, ["_was"], keep=["was"]), "numbered")
        columns = numbered.select("was", F.col("colour").alias("column"))
        if self.num_columns != self.num_cols:  # a column goes with the last of its samples
            columns = staged(metadata.assign(numbered.groupBy("was").agg(F.first("sample_name").alias("sample_name")), ["was"], keep=["was"]).select("was", F.col("colour").alias("column")), "kept")
        kept = columns.groupBy(words.word_of(F.col("was")).alias("word_no")).agg(F.bit_or(words.mask_of(F.col("was"))).alias("kept"), F.min("column").alias("start"))
        # One row for 64 columns on the right; a word number may be that of most words.
        closed = sig.compact(sig.closed_up(join_spread(self._signature(), staged(kept, "kept"), "word_no", "row_index")))
        return self._write(self.spark, self.path, self.m, self.compression, closed, numbered.join(columns, "was"), metadata.count(numbered), columns.count(), sum(p["words"] for p in self.parts))

    def compact(self, purge: bool = False) -> Index:
        """All parts as one. With `purge` without the deleted samples: their names are free again, and later samples get smaller numbers."""

        def made(base: Index) -> dict:
            if not base.parts:
                return {}
            part, deletes = (base._purged(), []) if purge else base._one_of(base.parts)
            return {"parts": [part], "deletes": deletes}

        return self._change(made)

    def tidy(self, fanout: int = FANOUT) -> Index:
        """Merges runs of at least `fanout` adjacent parts of about one size (of one power of it in words), as long as there are any.

        So every word is rewritten once for each power of `fanout` in the index's size, and parts stay few.
        """
        tier = lambda p: int(math.log(max(p["words"], 1), fanout))
        now = self
        while True:
            runs: list[list[dict]] = []
            for part in now.parts:
                if runs and tier(runs[-1][0]) == tier(part):
                    runs[-1].append(part)
                else:
                    runs.append([part])
            long = next((r for r in runs if len(r) >= fanout), None)
            if long is None:
                return now
            names = [p["name"] for p in long]

            def made(base: Index, names: list[str] = names) -> dict:
                run = [p for p in base.parts if p["name"] in names]
                if len(run) < len(names):
                    return {}  # another writer has merged them
                at = base.parts.index(run[0])
                part, deletes = base._one_of(run)
                return {"parts": [*base.parts[:at], part, *base.parts[at + len(run) :]], "deletes": deletes}

            now = now._change(made)

    def vacuum(self, keep: int = 1, older_than: float = 86_400.0) -> int:
        """Removes the commits before the last `keep`, and the tables that no commit left names; returns how many were removed.

        Tables younger than `older_than` seconds stay, as they may be those of a change that is not committed yet.
        """
        made = commits.numbers(self.spark, self.path)
        kept = [commits.read(self.spark, self.path, n) for n in made[-max(keep, 1) :]]
        used = {p["name"] for state in kept for p in state["parts"]} | {t for state in kept for t in state["deletes"]}
        gone = [f"commits/{n}.json" for n in made[: -max(keep, 1)]]
        before = time.time() - older_than
        gone += [f"commits/{name}" for name, at in commits.listed(self.spark, f"{self.path}/commits").items() if name.startswith(".") and not name.endswith(".crc") and at <= before]
        for kind in ("signature", "samples", "deletes"):
            gone += [f"{kind}/{name}" for name, at in commits.listed(self.spark, f"{self.path}/{kind}").items() if name not in used and at <= before]
        for name in gone:
            commits.remove(self.spark, f"{self.path}/{name}")
        return len(gone)

    def delete(self) -> None:
        """Removes this index's directory and nothing else."""
        commits.remove(self.spark, self.path)
