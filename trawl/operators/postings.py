"""A stored keyword index: postings by term, with insertion, replacement, removal and rebuilding.

One row for every (term, chunk): how often and where the term stands in each field, and the
chunk's length, so that ranking needs no other table. Rows lie in folders by a hash of the
term, sorted by term in each file: a query opens its terms' folders only and skips the row
groups of other terms. A small dictionary (term, chunks) resolves prefixes and counts.

The index is a list of segments. A change writes one segment with the postings of the chunks
it touches and a tombstone for each of them that hides older segments' rows; nothing else is
rewritten. ``compact`` merges the segments. A manifest, replaced in one step, says what counts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.operators.keyword import FIELDS, Node, Phrase, bm25_part, idf, parse, phrases_of, tokenized
from trawl.shipping import ship
from trawl.sources import folders

ship(__name__)

#: Tokens of a folder of postings, and the most folders.
BUCKET_TOKENS, MOST_BUCKETS = 5_000_000, 4096
#: Terms that a prefix is written out to; beyond it the rows are filtered by the prefix itself.
PREFIX_TERMS = 5_000
#: Terms that are written into a filter; more are joined.
LISTED_TERMS = 100
#: Removed chunks (some 30 bytes) that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bucket_of(term: str, buckets: int) -> int:
    """The same at the driver."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


POSTING = "term string, chunk_id string, length int, n int, " + ", ".join([*(f"n_{f} int" for f in FIELDS), *(f"p_{f} array<int>" for f in FIELDS)])


def _grouped(batches):
    """Postings of batches of (chunk_id, tokens of each field): a chunk's tokens are in one row, so nothing is shuffled."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            lists = [part.column(1 + i) for i in range(len(FIELDS))]
            sizes = np.array([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int64)
            owner = np.concatenate([np.repeat(np.arange(len(part)), n) for n in sizes])
            field = np.repeat(np.arange(len(FIELDS)), sizes.sum(axis=1))
            position = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes])
            terms = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            code = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            key = owner * max(len(terms.dictionary), 1) + code
            order = np.lexsort((position, field, key))
            key, field, position = key[order], field[order], position[order].astype(np.int32)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
            counts = [np.bincount(group[field == i], minlength=len(first)).astype(np.int32) for i in range(len(FIELDS))]
            places = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(position[field == i])) for i, n in enumerate(counts)]
            row = owner[order][first]
            yield pa.RecordBatch.from_arrays(
                [
                    terms.dictionary.take(pa.array(code[order][first])),
                    part.column(0).take(pa.array(row)),
                    pa.array(sizes.sum(axis=0)[row].astype(np.int32)),
                    pa.array(sum(counts).astype(np.int32)),
                    *[pa.array(n) for n in counts],
                    *places,
                ],
                ["term", "chunk_id", "length", "n", *[f"n_{f}" for f in FIELDS], *[f"p_{f}" for f in FIELDS]],
            )


def posting_rows(tokens: DataFrame) -> DataFrame:
    """term, chunk_id, length, n (all fields), n_<field> and p_<field> (positions) from tokenized chunks."""
    return tokens.select("chunk_id", *[F.coalesce(f, F.array().cast("array<string>")).alias(f) for f in FIELDS]).mapInArrow(_grouped, POSTING)


class Unstored:
    """Postings of tokenized chunks, computed as they are asked for."""

    def __init__(self, tokens: DataFrame, stemmed: bool = True):
        self.stemmed, self._rows = stemmed, posting_rows(tokens)
        length = sum((F.size(f) for f in FIELDS), F.lit(0))
        self.n, total = tokens.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
        self.average = total / self.n if self.n else 0.0

    def rows(self, terms: list[str], prefixes: list[str]) -> DataFrame:
        wanted = F.col("term").isin(terms) if terms else F.lit(False)
        for p in prefixes:
            wanted = wanted | F.col("term").startswith(p)
        return self._rows.filter(wanted)

    def every(self) -> DataFrame:
        return self._rows


class KeywordIndex:
    """The stored index under ``root``, in any file system Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, stemmed: bool = True):
        self.spark, self.root, self.stemmed = spark, root.rstrip("/"), stemmed
        self._load()

    def _load(self) -> None:
        text = folders.read_text(self.spark, f"{self.root}/MANIFEST")
        self.state = json.loads(text) if text else {"n": 0, "tokens": 0, "buckets": 1, "segments": [], "dead": [], "n_dead": 0, "next": 0, "stemmed": self.stemmed}
        self.stemmed = self.state["stemmed"]

    @property
    def n(self) -> int:
        return self.state["n"]

    @property
    def average(self) -> float:
        return self.state["tokens"] / self.n if self.n else 0.0

    def exists(self) -> bool:
        return bool(self.state["segments"])

    def _publish(self, **changes) -> None:
        self.state = self.state | changes
        folders.publish(self.spark, f"{self.root}/MANIFEST", json.dumps(self.state))

    # --- changes ---------------------------------------------------------------------------

    def _segment(self, chunks: DataFrame, number: int, buckets: int | None) -> tuple[int, int, int]:
        """Writes a segment; (chunks, tokens, folders)."""
        path = f"{self.root}/segment={number}"
        # with positions, tokens are needed twice; they are written once
        tokenized(chunks, self.stemmed).write.parquet(f"{path}/tokens")
        tokens = self.spark.read.parquet(f"{path}/tokens")
        length = sum((F.size(f) for f in FIELDS), F.lit(0))
        tokens.select("chunk_id", length.cast("long").alias("length")).write.parquet(f"{path}/lengths")
        n, total = self.spark.read.parquet(f"{path}/lengths").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        buckets = buckets or max(8, min(MOST_BUCKETS, total // BUCKET_TOKENS))
        rows = posting_rows(tokens).withColumn("bucket", bucket(F.col("term"), buckets))
        # a rebalance splits the folders of frequent terms over files
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "chunk_id").write.partitionBy("bucket").parquet(f"{path}/postings")
        rows = self.spark.read.schema(rows.schema).parquet(f"{path}/postings")
        rows.groupBy("term").agg(F.count("*").alias("chunks")).write.parquet(f"{path}/terms")
        folders.remove(self.spark, f"{path}/tokens")
        return n, total, buckets

    def rebuild(self, chunks: DataFrame) -> None:
        """Everything anew from chunks (chunk_id, content, name, path)."""
        old, number = self.state["segments"], self.state["next"]
        n, total, buckets = self._segment(chunks, number, None)
        self._publish(n=n, tokens=total, buckets=buckets, segments=[number], dead=[], n_dead=0, next=number + 1, stemmed=self.stemmed)
        for s in old:
            folders.remove(self.spark, f"{self.root}/segment={s}")

    def _bury(self, ids: DataFrame, number: int) -> tuple[int, int]:
        """Hides the chunks from the segments so far; how many there were, and their tokens."""
        path = f"{self.root}/segment={number}/dead"
        live = self._lengths().join(ids.select("chunk_id").distinct(), "chunk_id")
        live.select("chunk_id", "length", F.lit(number).alias("upto")).write.parquet(path)
        return tuple(self.spark.read.parquet(path).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first())

    def remove(self, ids: DataFrame) -> None:
        """Forgets chunks (chunk_id)."""
        if not self.exists():
            return
        number = self.state["next"]
        n, tokens = self._bury(ids, number)
        s = self.state
        self._publish(n=s["n"] - n, tokens=s["tokens"] - tokens, dead=[*s["dead"], number], n_dead=s["n_dead"] + n, next=number + 1)

    def add(self, chunks: DataFrame, gone: DataFrame | None = None) -> None:
        """Inserts chunks; those whose id is known are replaced. Forgets those in ``gone`` (chunk_id) in the same step."""
        if not self.exists():
            self.rebuild(chunks)
            return
        number, s = self.state["next"], self.state
        buried, lost = self._bury(chunks.select("chunk_id") if gone is None else chunks.select("chunk_id").unionByName(gone.select("chunk_id")), number)
        n, tokens, _ = self._segment(chunks, number, s["buckets"])
        self._publish(
            n=s["n"] - buried + n, tokens=s["tokens"] - lost + tokens, dead=[*s["dead"], number], n_dead=s["n_dead"] + buried,
            segments=[*s["segments"], number], next=number + 1,
        )

    def compact(self) -> None:
        """Merges all segments into one, without what was removed."""
        number, old = self.state["next"], {*self.state["segments"], *self.state["dead"]}
        path, buckets = f"{self.root}/segment={number}", self.state["buckets"]
        rows = self.every().withColumn("bucket", bucket(F.col("term"), buckets))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "chunk_id").write.partitionBy("bucket").parquet(f"{path}/postings")
        self._lengths().drop("segment").write.parquet(f"{path}/lengths")
        self.spark.read.schema(rows.schema).parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("chunks")).write.parquet(f"{path}/terms")
        self._publish(segments=[number], dead=[], n_dead=0, next=number + 1)
        for s in old:
            folders.remove(self.spark, f"{self.root}/segment={s}")

    # --- reading ---------------------------------------------------------------------------

    def _read(self, name: str, schema: str) -> DataFrame:
        out = None
        for s in self.state["segments"]:
            part = self.spark.read.schema(schema).parquet(f"{self.root}/segment={s}/{name}").withColumn("segment", F.lit(s))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], f"{schema}, segment int")

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self.state["n_dead"]:
            return rows
        dead = self.spark.read.parquet(*[f"{self.root}/segment={s}/dead" for s in self.state["dead"]])
        dead = dead.groupBy(F.col("chunk_id").alias("_gone")).agg(F.max("upto").alias("_upto"))
        dead = F.broadcast(dead) if self.state["n_dead"] <= BROADCAST_ROWS else dead
        return rows.join(dead, (rows["chunk_id"] == dead["_gone"]) & (rows["segment"] < dead["_upto"]), "left_anti")

    def _lengths(self) -> DataFrame:
        return self._live(self._read("lengths", "chunk_id string, length long"))

    def _postings(self) -> DataFrame:
        return self._read("postings", f"{POSTING}, bucket int")

    def every(self) -> DataFrame:
        return self._live(self._postings()).drop("bucket", "segment")

    def terms(self) -> DataFrame:
        """term and the number of its chunks, removed ones included until the next compaction."""
        return self._read("terms", "term string, chunks long").groupBy("term").agg(F.sum("chunks").alias("chunks"))

    def rows(self, terms: list[str], prefixes: list[str]) -> DataFrame:
        """Live postings of the terms and of all terms with one of the prefixes; other folders aren't opened."""
        wanted, rest = set(terms), []
        for p in prefixes:
            found = self._read("terms", "term string, chunks long").filter(F.col("term").startswith(p)).select("term").distinct().limit(PREFIX_TERMS + 1).collect()
            if len(found) > PREFIX_TERMS:
                rest.append(p)
            wanted |= {r["term"] for r in found}
        rows = self._postings()
        if not rest and wanted:
            rows = rows.filter(F.col("bucket").isin(sorted({bucket_of(t, self.state["buckets"]) for t in wanted})))
        if not rest and len(wanted) > LISTED_TERMS:
            # at most PREFIX_TERMS for each prefix, or as many as the caller counted
            own = F.broadcast(self.spark.createDataFrame([(t,) for t in sorted(wanted)], "term string"))
            return self._live(rows.join(own, "term", "left_semi")).drop("bucket", "segment")
        hit = F.col("term").isin(sorted(wanted)) if wanted else F.lit(False)
        for p in rest:
            hit = hit | F.col("term").startswith(p)
        return self._live(rows.filter(hit)).drop("bucket", "segment")


def _counts(rows: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """chunk_id, length and tf<i>: how often each phrase stands in the chunk, from its tokens' postings."""
    found, after = [F.first("length").alias("length")], {}
    for i, p in enumerate(phrases):
        fields = [f for f in FIELDS if p.field in (None, f)]
        if len(p.tokens) == 1:
            n = F.col("n") if p.field is None else F.col(f"n_{p.field}")
            found.append(F.coalesce(F.sum(F.when(_is(p, 0), n)), F.lit(0)).alias(f"tf{i}"))
            continue
        for f in fields:
            for j in range(len(p.tokens)):
                found.append(F.flatten(F.collect_list(F.when(_is(p, j), F.col(f"p_{f}")))).alias(f"at{i}_{f}_{j}"))

        def adjacent(f: str, i: int = i, p: Phrase = p) -> Column:
            def fits(x: Column) -> Column:
                ok = F.lit(True)
                for j in range(1, len(p.tokens)):
                    ok = ok & F.array_contains(F.col(f"at{i}_{f}_{j}"), x + j)
                return ok

            return F.size(F.filter(F.col(f"at{i}_{f}_0"), fits))

        after[f"tf{i}"] = sum((adjacent(f) for f in fields), F.lit(0))
    out = rows.groupBy("chunk_id").agg(*found)
    return out.withColumns(after).select("chunk_id", "length", *[f"tf{i}" for i in range(len(phrases))]) if after else out


def _is(p: Phrase, j: int) -> Column:
    t = F.col("term")
    return t.startswith(p.tokens[j]) if p.prefix and j == len(p.tokens) - 1 else t == p.tokens[j]


def search(index: Unstored | KeywordIndex, query: str, limit: int, within: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score) of the best matches of a raw query, from its terms' postings alone.

    ``within`` (chunk_id) restricts the results; weights stay those of the whole index.
    """
    tree = parse(query, index.stemmed)
    phrases = list(dict.fromkeys(phrases_of(tree))) if tree else []
    exact = sorted({t for p in phrases for t in (p.tokens[:-1] if p.prefix else p.tokens)})
    rows = index.rows(exact, sorted({p.tokens[-1] for p in phrases if p.prefix}))
    if tree is None or limit <= 0:
        return rows.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    counted = _counts(rows, phrases)
    # one plan: the counts are a subquery that reuses the exchange
    spread = counted.agg(F.struct(*[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"n{i}") for i in range(len(phrases))]).alias("s")).scalar()

    def holds(node: Node | Phrase) -> Column:
        if isinstance(node, Phrase):
            return F.col(f"tf{phrases.index(node)}") > 0
        left, right = holds(node.left), holds(node.right)
        return left & right if node.op == "AND" else left | right if node.op == "OR" else left & ~right

    score = F.lit(0.0)
    for i in range(len(phrases)):
        score = score + idf(index.n, spread[f"n{i}"]) * bm25_part(F.col(f"tf{i}"), F.col("length"), index.average or 1.0)
    found = counted.filter(holds(tree)).select("chunk_id", F.round(score, 6).alias("score"))
    found = found if within is None else found.join(within.select("chunk_id"), "chunk_id", "left_semi")
    return found.orderBy(F.desc("score"), "chunk_id").limit(limit)


def search_batch(index: Unstored | KeywordIndex, queries: DataFrame | list[tuple[int, list[str]]], k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank) for queries (query_id, terms), a table or a short list, any term matching.

    The postings are read once, however many queries there are; few terms open their folders only.
    """
    if isinstance(queries, list):
        pairs = sorted({(q, t) for q, terms in queries for t in terms})
        few = sorted({t for _, t in pairs})
        wanted = F.broadcast(index.every().sparkSession.createDataFrame(pairs, "query_id int, term string"))
    else:
        wanted = queries.select("query_id", F.explode("terms").alias("term")).distinct()
        few = [r["term"] for r in wanted.select("term").distinct().limit(PREFIX_TERMS + 1).collect()]
    if len(few) <= PREFIX_TERMS:
        hits = index.rows(few, [])
    else:
        hits = index.every().join(wanted.select("term").distinct(), "term", "left_semi")
    hits = hits.select("term", "chunk_id", "length", "n")
    spread = hits.groupBy("term").agg(F.count("*").alias("df"))
    part = idf(index.n, F.col("df")) * bm25_part(F.col("n"), F.col("length"), index.average or 1.0)
    scored = hits.join(spread, "term").withColumn("part", part).join(wanted, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))
    # the rank's filter becomes a limit per group, taken before the rows of a query meet
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
