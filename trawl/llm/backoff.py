"""Stupid-backoff language-model scores, computed over hash-partitioned n-gram tables.

Words are lower-cased (A-Z). With corpus counts c and N words in all, a word is scored

    c(v w) / c(v)         if the pair (v, w) occurs at least MIN_COUNT times,
    ALPHA * c(w) / N      otherwise;      c(w) / N for a text's first word,

and a document's score is the sum of the natural logarithms. The counts come from all
documents, the scored one included, so that every pair occurs once at least; MIN_COUNT = 2 is
thus the rule "seen anywhere else", and 1 the plain one, by which nothing is ever backed off
within the corpus. Order 2; the tables hold unigrams and pairs.

Exploded pairs are dealt by a hash of their first word, so one partition holds both c(v w)
and c(v): the count tables and their join need one exchange. Pairs travel in packed
columns (one row for a bucket and a chunk of documents). Frequent words would overload
their bucket, so the words and pairs that a bounded sample shows in over ``HOT_SHARE`` of
the documents are counted over everything beforehand by partial sums; pairs after a
frequent word are dealt by both words, and frequent pairs are scored where they are read.
Backed-off words meet the unigram table in a second, smaller exchange, and partial sums
are added up per chunk of documents. Whether something counts as frequent never changes
a score. Buckets are as many as keep each at ``BUCKET`` words.

Defined cases: null and empty texts have no words and score 0; repeated rows count and are
scored each; an empty table yields none. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.base import Scratch
from trawl.shipping import ship

ship(__name__)

ALPHA, MIN_COUNT = 0.4, 2
#: Documents of the sample for frequent words and pairs, their least share, and the most that are kept.
SAMPLE, HOT_SHARE, HOT_MOST = 8000, 0.002, 60_000
#: Words of a bucket and of a chunk; a chunk has at most 2^16 documents.
BUCKET, CHUNK, CHUNK_DOCS = 1_000_000, 1_000_000, 1 << 16
SEED = 3
#: Codes: frequent words have their number, others a hash of at least FIRST; END follows a text's last word.
END, FIRST = np.uint64(HOT_MOST), np.uint64(1 << 16)
PACKED = "bucket int, kind int, chunk long, a binary, b binary, c binary, d binary"
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh3_64_digest
    h = np.frombuffer(b"".join([digest(w) for w in (text or "").encode("utf-8", "replace").lower().split()]), dtype=">u8")
    return np.maximum(h.astype(np.uint64), FIRST)


def _mix(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = v * _K1 + w * _K2
    h ^= h >> np.uint64(31)
    h *= _K2
    return h ^ (h >> np.uint64(29))


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x, at


class Hot:
    """The frequent words (sorted hashes) and pairs (sorted codes), with their counts."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray):
        self.words, self.pairs = words, pairs
        self.n_words = np.zeros(len(words), np.int64)
        self.n_pairs = np.zeros(len(pairs), np.int64)

    def code(self, h: np.ndarray) -> np.ndarray:
        hit, at = _find(self.words, h)
        return np.where(hit, at.astype(np.uint64), h)

    def pair(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether both are frequent and their pair is, and its number."""
        both = (v < END) & (w < END)
        hit, at = np.zeros(len(v), bool), np.zeros(len(v), np.int64)
        hit[both], at[both] = _find(self.pairs, v[both] << np.uint64(16) | w[both])
        return hit, at


def _chunks(batches, hot: Hot, columns: int):
    """(ids, words of each text, codes, place of each text's first word) for chunks of whole texts."""
    ids, codes, total = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for i, t in enumerate(part.column(columns - 1).to_pylist()):
                h = word_hashes(t)
                ids.append(part.column(0)[i].as_py() if columns > 1 else None)
                codes.append(h)
                total += len(h)
                if total >= CHUNK or len(ids) == CHUNK_DOCS:
                    yield ids, np.array([len(c) for c in codes]), hot.code(np.concatenate(codes))
                    ids, codes, total = [], [], 0
    if ids:
        yield ids, np.array([len(c) for c in codes]), hot.code(np.concatenate(codes))


def _pairs(sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, word and next word (or END) of every position; positions of first words."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    after = np.append(code[1:], END) if len(code) else code
    ends = np.cumsum(sizes)
    starts = ends - sizes
    after[ends[sizes > 0] - 1] = END
    return doc, code, after, starts[sizes > 0]


# --- frequent words and pairs --------------------------------------------------------------


def find_hot(docs: DataFrame, n_docs: int) -> Hot:
    """From a hash-chosen sample of some SAMPLE documents, gathered as counts of documents."""
    dice = F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    sample = docs.filter(dice < min(1.0, SAMPLE / max(n_docs, 1))).select("text")

    def words(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                seen = [np.unique(word_hashes(t)) for t in batch.slice(at, 256).column(0).to_pylist()]
                v, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], ["v", "n"])

    least = max(3, HOT_SHARE * min(SAMPLE, n_docs))

    def top(counted: DataFrame) -> np.ndarray:
        rows = counted.groupBy("v").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "v").limit(HOT_MOST)
        return np.sort(np.array([r["v"] for r in rows.collect()], dtype=np.int64).view(np.uint64))

    hot = Hot(top(sample.mapInArrow(words, "v long, n long")), np.zeros(0, np.uint64))

    def pairs(batches):
        for _, sizes, code in _chunks(batches, hot, 1):
            doc, v, w, _ = _pairs(sizes, code)
            both = (v < END) & (w < END)
            # codes of pairs leave 32 bits for the document
            once = np.unique((v[both] << np.uint64(48)) | (w[both] << np.uint64(32)) | doc[both].astype(np.uint64))
            v, n = np.unique(once >> np.uint64(32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], ["v", "n"])

    return Hot(hot.words, top(sample.mapInArrow(pairs, "v long, n long")))


def count_hot(docs: DataFrame, hot: Hot) -> int:
    """Fills in the counts over all documents; returns the number of words of all texts."""

    def count(batches):
        n_words, n_pairs, total = np.zeros(len(hot.words), np.int64), np.zeros(len(hot.pairs), np.int64), 0
        for _, sizes, code in _chunks(batches, hot, 1):
            _, v, w, _ = _pairs(sizes, code)
            n_words += np.bincount(v[v < END].astype(np.int64), minlength=len(n_words))
            hit, at = hot.pair(v, w)
            n_pairs += np.bincount(at[hit], minlength=len(n_pairs))
            total += len(code)
        kind = np.repeat([0, 1, 2], [len(n_words), len(n_pairs), 1])
        at = np.concatenate([np.arange(len(n_words)), np.arange(len(n_pairs)), [0]])
        n = np.concatenate([n_words, n_pairs, [total]])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(n)], ["kind", "at", "n"])

    total = 0
    rows = docs.select("text").mapInArrow(count, "kind long, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n"))
    for kind, at, n in rows.collect():  # at most 2 * HOT_MOST + 1 rows
        if kind == 0:
            hot.n_words[at] = n
        elif kind == 1:
            hot.n_pairs[at] = n
        else:
            total = n
    return total


# --- packed rows ---------------------------------------------------------------------------


def _pack(code: np.ndarray) -> tuple[bytes, bytes]:
    """Codes as two-byte numbers (the largest marks a hash) and the hashes apart."""
    cold = code >= FIRST
    return np.where(cold, np.uint64(0xFFFF), code).astype(np.uint16).tobytes(), code[cold].tobytes()


def _unpack(short: bytes, hashes: bytes) -> np.ndarray:
    code = np.frombuffer(short, np.uint16).astype(np.uint64)
    code[code == 0xFFFF] = np.frombuffer(hashes, np.uint64)
    return code


def _row(bucket: int, kind: int, chunk: int, *parts: bytes) -> tuple:
    return (bucket, kind, chunk, *parts, *[b""] * (4 - len(parts)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "kind", "chunk", "a", "b", "c", "d"])


#: kinds of packed rows: pairs after other words, pairs after frequent words, first words, documents, sums, backed-off words, unigrams
COLD, WARM, HEADS, DOCS, SUMS, MISSES, UNIGRAMS = range(7)


def _split(bucket: np.ndarray):
    """(bucket, slice) over rows ordered by bucket."""
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(at, np.r_[at[1:], len(bucket)] if len(bucket) else [], strict=True):
        yield int(bucket[a]), slice(a, b)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def explode(docs: DataFrame, hot: Hot, total: int, buckets: int) -> DataFrame:
    """Packed rows of all pairs, first words and documents."""

    def over(batches):
        task = TaskContext.get().partitionId()
        ln_w, ln_p = np.log(np.maximum(hot.n_words, 1)), np.log(np.maximum(hot.n_pairs, 1))
        ln_n, ln_a = math.log(max(total, 1)), math.log(ALPHA)
        for seq, (ids, sizes, code) in enumerate(_chunks(batches, hot, 2)):
            chunk = task << 32 | seq
            doc, v, w, starts = _pairs(sizes, code)
            score = np.zeros(len(sizes))
            # frequent pairs need nothing else
            hit, at = hot.pair(v, w)
            often = hit & (hot.n_pairs[at] >= MIN_COUNT) if len(hot.pairs) else hit
            if hit.any():
                value = np.where(often[hit], ln_p[at[hit]] - ln_w[v[hit].astype(np.int64)], ln_a + ln_w[w[hit].astype(np.int64)] - ln_n)
                score += np.bincount(doc[hit], value, len(sizes))
            head, head_doc = code[starts], doc[starts]
            known = head < END
            score += np.bincount(head_doc[known], ln_w[head[known].astype(np.int64)] - ln_n, len(sizes)) if known.any() else 0
            rows = [_row(-1 - chunk % buckets, DOCS, chunk, np.array([-(1 << 63) if i is None else i for i in ids], np.int64).tobytes(), sizes.astype(np.int64).tobytes(), score.tobytes())]
            # first words that aren't frequent
            head, head_doc = head[~known], head_doc[~known]
            order = np.argsort(head)
            head, head_doc = head[order], head_doc[order]
            for b, s in _split(_bucket_of(head, buckets)):
                rows.append(_row(b, HEADS, chunk, head[s].tobytes(), head_doc[s].astype(np.uint16).tobytes()))
            # pairs after other words, in the order of the first
            cold = np.flatnonzero(v >= FIRST)
            cold = cold[np.argsort(v[cold])]
            for b, s in _split(_bucket_of(v[cold], buckets)):
                pick = cold[s]
                first, runs = np.unique(v[pick], return_counts=True)
                rows.append(_row(b, COLD, chunk, first.tobytes() + runs.astype(np.uint32).tobytes(), *_pack(w[pick]), doc[pick].astype(np.uint16).tobytes()))
            # pairs after frequent words; a text's last word needs no pair, its count is known
            warm = np.flatnonzero((v < END) & ~hit & (w != END))
            where = _bucket_of(_mix(v[warm], w[warm]), buckets)
            order = np.lexsort((v[warm], where))
            warm, where = warm[order], where[order]
            for b, s in _split(where):
                pick = warm[s]
                rows.append(_row(b, WARM, chunk, v[pick].astype(np.uint16).tobytes(), *_pack(w[pick]), doc[pick].astype(np.uint16).tobytes()))
            for at in range(0, len(rows), 64):
                yield _batch(rows[at : at + 64])

    return docs.select("doc_id", "text").mapInArrow(over, PACKED)


def _sums(chunks: np.ndarray, names: list[int], doc: np.ndarray, value: np.ndarray):
    """Partial sums per chunk as packed rows, for the chunks ``names`` that ``chunks`` numbers."""
    key = chunks.astype(np.int64) << 16 | doc.astype(np.int64)
    at, inverse = np.unique(key, return_inverse=True)
    total = np.bincount(inverse, value, len(at)) if len(at) else np.zeros(0)
    for k, s in _split(at >> 16):
        yield _row(0, SUMS, names[k], (at[s] & 0xFFFF).astype(np.uint16).tobytes(), total[s].tobytes())


def score_pairs(packed: DataFrame, hot: Hot, total: int) -> DataFrame:
    """Joins each bucket's pairs with their counts: sums, backed-off words, unigrams (and documents as they are)."""

    def of(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if rows and rows[0]["bucket"] < 0:
            return table
        ln_w = np.log(np.maximum(hot.n_words, 1))
        ln_n, ln_a = math.log(max(total, 1)), math.log(ALPHA)
        names, vs, ws, docs, chunks, firsts, counts, heads = [], [], [], [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for r in rows:
            k = len(names)
            names.append(r["chunk"])
            if r["kind"] == HEADS:
                heads.append((k, np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint16)))
                continue
            if r["kind"] == COLD:
                n = len(r["a"]) // 12
                first, runs = np.frombuffer(r["a"][: 8 * n], np.uint64), np.frombuffer(r["a"][8 * n :], np.uint32)
                firsts.append(first)
                counts.append(runs.astype(np.int64))
                v = np.repeat(first, runs)
            else:
                v = np.frombuffer(r["a"], np.uint16).astype(np.uint64)
            vs.append(v)
            ws.append(_unpack(r["b"], r["c"]))
            d = np.frombuffer(r["d"], np.uint16)
            docs.append(d)
            chunks.append(np.full(len(d), k, np.int32))
        bucket, out = rows[0]["bucket"] if rows else 0, []
        # the unigram table of this bucket's other words
        word, inverse = np.unique(np.concatenate(firsts), return_inverse=True)
        ln_c = np.log(np.maximum(np.bincount(inverse, np.concatenate(counts), len(word)), 1)) if len(word) else np.zeros(0)
        out.append(_row(bucket, UNIGRAMS, 0, word.tobytes(), ln_c.tobytes()))
        for k, h, d in heads:
            out += _sums(np.full(len(d), k), names, d, ln_c[np.searchsorted(word, h)] - ln_n)
        if vs:
            v, w, d, k = (np.concatenate(x) for x in (vs, ws, docs, chunks))
            del vs, ws, docs, chunks
            scored = w != END
            v, w, d, k = v[scored], w[scored], d[scored], k[scored]
            pair = _mix(v, w)
            order = np.argsort(pair)
            new = np.r_[True, pair[order][1:] != pair[order][:-1]] if len(pair) else np.zeros(0, bool)
            number = np.cumsum(new) - 1
            n = np.empty(len(pair), np.int64)
            n[order] = np.bincount(number)[number] if len(pair) else 0
            hit = n >= MIN_COUNT
            cold = v >= FIRST
            ln_v = np.empty(len(v))
            ln_v[cold] = ln_c[np.searchsorted(word, v[cold])]
            ln_v[~cold] = ln_w[v[~cold].astype(np.int64)]
            known = w < END
            value = np.full(len(v), ln_a - ln_n)
            value[~hit & known] += ln_w[w[~hit & known].astype(np.int64)]
            value[hit] = np.log(n[hit]) - ln_v[hit]
            out += _sums(k, names, d, value)
            miss = np.flatnonzero(~hit & ~known)
            where = _bucket_of(w[miss], buckets)
            order = np.lexsort((k[miss], where))
            miss, where = miss[order], where[order]
            for b, s in _split(where):
                pick = miss[s]
                number, runs = np.unique(k[pick], return_counts=True)
                own = np.array([names[i] for i in number], np.int64).tobytes() + runs.astype(np.uint32).tobytes()
                out.append(_row(b, MISSES, 0, w[pick].tobytes(), d[pick].tobytes(), own))
        return pa.Table.from_batches([_batch(out)])

    buckets = _buckets(total)
    return packed.groupBy("bucket").applyInArrow(of, PACKED)


def score_misses(rows: DataFrame) -> DataFrame:
    """Joins backed-off words with the unigram table of their bucket: further sums."""

    def of(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        tables = [r for r in rows if r["kind"] == UNIGRAMS]
        word, ln_c = (np.concatenate([np.frombuffer(r[c], t) for r in tables]) for c, t in (("a", np.uint64), ("b", np.float64))) if tables else (np.zeros(0, np.uint64), np.zeros(0))
        number: dict[int, int] = {}
        k, w, d = [], [], []
        for r in rows:
            if r["kind"] == MISSES:
                n = len(r["c"]) // 12
                own = [number.setdefault(int(c), len(number)) for c in np.frombuffer(r["c"][: 8 * n], np.int64)]
                k.append(np.repeat(np.array(own, np.int64), np.frombuffer(r["c"][8 * n :], np.uint32)))
                w.append(np.frombuffer(r["a"], np.uint64))
                d.append(np.frombuffer(r["b"], np.uint16))
        if not k:
            return pa.Table.from_batches([_batch([])])
        k, w, d = np.concatenate(k), np.concatenate(w), np.concatenate(d)
        return pa.Table.from_batches([_batch(list(_sums(k, list(number), d, ln_c[np.searchsorted(word, w)])))])

    return rows.groupBy("bucket").applyInArrow(of, PACKED)


def add_up(rows: DataFrame) -> DataFrame:
    """doc_id, n_words and score of every document, chunk by chunk."""

    def of(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        docs = next(r for r in rows if r["kind"] == DOCS)
        ids, sizes = np.frombuffer(docs["a"], np.int64), np.frombuffer(docs["b"], np.int64)
        score = np.frombuffer(docs["c"], np.float64).copy()
        for r in rows:
            if r["kind"] == SUMS:
                score[np.frombuffer(r["a"], np.uint16)] += np.frombuffer(r["b"], np.float64)
        null = ids == -(1 << 63)
        return pa.table({"doc_id": pa.array(ids, mask=null), "n_words": pa.array(sizes), "score": pa.array(score)})

    return rows.groupBy("chunk").applyInArrow(of, "doc_id long, n_words long, score double")


def _buckets(total: int) -> int:
    return max(1, -(-total // BUCKET))


def score(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, n_words and score (sum of log scores), one row per row of ``docs``."""
    scratch = Scratch(spark)
    hot = find_hot(docs, docs.count())
    total = count_hot(docs, hot)
    packed = explode(docs, hot, total, _buckets(total))
    first = scratch.save(score_pairs(packed, hot, total), "pairs")
    more = score_misses(first.filter(F.col("kind").isin(MISSES, UNIGRAMS)))
    return add_up(first.filter(F.col("kind").isin(DOCS, SUMS)).union(more))
