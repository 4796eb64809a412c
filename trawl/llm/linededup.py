"""Fuzzy line deduplication by MinHash, keeping one line of each component.

A line's shingles are its runs of 10 characters at every position; a shorter line is its
own. ``minhash`` gives every line 8 band keys of 3 digests each, so that pairs of similarity
0.8 share a key in 99.7 %. Lines that meet are verified by their exact Jaccard similarity and
linked; a distributed union-find gives the components. Equal lines are one line from the
start. Signatures and similarities are numpy over Arrow batches (a native form takes several
times the CPU, see the README); everything between is DataFrames.

In a bucket every line is compared with the commonest; in buckets up to ``ALL_PAIRS`` lines
so are all pairs that this leaves in different components. Lines of larger buckets that aren't one component then are dealt anew by
longer keys; where those share a large bucket without a link again, they meet the
bucket's other lines by prefix filtering: similar sets share one of their rarest shingles.
Large groups of copies thus cost about as many comparisons as they have lines, and no link
between components is given up for a bucket's size.

Of a component the line that comes first, by (doc_id, text digest, line number), stays.
Lines without a word are never touched. Defined cases: null texts stay null and have no
lines; rows that agree in id and text keep the same lines; documents may end up without a
line. The columns of the input stay as they are, but for ``text``; columns named n_lines and
n_kept are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trawl.llm import minhash, runs
from trawl.llm.base import BROADCAST_ROWS, Scratch, fresh, joined, let, numbered, rows, small
from trawl.llm.components import components

SHINGLE = 10
#: Similarity as a fraction: shared / union >= NUM / DEN.
NUM, DEN = 4, 5
ALL_PAIRS = 16

BLANKS = " \t\n\x0b\x0c\r"


#: Runs of characters at every position; ``CHARACTERS`` is the same measure in numpy, which tests compare with it.
RUNS = runs.Characters(SHINGLE, NUM, DEN)
CHARACTERS = minhash.characters(SHINGLE)


def _lines(docs: DataFrame) -> DataFrame:
    """at (doc_id, th: digest of the text, line_no), id (two digests of the line, 128 bits), line."""
    at = F.struct("doc_id", "th", "line_no").alias("at")
    id_ = F.struct(F.xxhash64("line").alias("d1"), F.xxhash64(F.lit(1), F.col("line")).alias("d2")).alias("id")
    return (
        docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .filter(F.ltrim("line", F.lit(BLANKS)) != "")
        .select(at, id_, "line")
    )


def _verify(pairs: DataFrame, lines: DataFrame, measure, sketches: DataFrame | None, longest: int) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity is NUM / DEN or more."""
    pairs = pairs if sketches is None else measure.possible(pairs, sketches)
    for end, line in (("a", "x"), ("b", "y")):
        pairs = joined(pairs, end, lines.select("id", F.col("line").alias(line)))
    return measure.similar(pairs.select("a", "b", "x", "y"), longest)


def _short(df: DataFrame, most: int, scratch: Scratch, name: str) -> DataFrame:
    """``df`` of at most ``most`` rows for a join: broadcast if they are few, otherwise written and counted."""
    return F.broadcast(df) if most <= BROADCAST_ROWS else small(scratch.save(df, name))


def distinct(lines: DataFrame) -> DataFrame:
    """(id, line, n): different lines and their number."""
    return lines.groupBy("id", "line").agg(F.count("*").alias("n"))  # by both, so that lines are hashed, not sorted


def _meetings(keyed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(key, id, size, rep) of the keys that two lines or more share, with their number and the commonest."""
    keys = [c for c in keyed.columns if c not in ("id", "n")]
    exploded = keyed.select("id", "n", F.explode(F.array(*keys)).alias("key")).filter("key is not null")
    shared = scratch.save(exploded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), f"{name}-shared")
    met = scratch.save(exploded.join(small(shared), "key"), f"{name}-met")
    reps = _short(met.groupBy("key").agg(F.max(F.struct("n", "id"))["id"].alias("rep")), rows(shared), scratch, f"{name}-reps")
    return scratch.save(met.select("key", "id", "size").join(reps, "key"), f"{name}-meetings")


def _stars(met: DataFrame) -> DataFrame:
    """Pairs (a, b): every line with its bucket's commonest."""
    return met.filter("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()


def _others(met: DataFrame) -> DataFrame:
    """Pairs (a, b): all others of small buckets."""
    few = met.filter((F.col("size") > 2) & (F.col("size") <= ALL_PAIRS) & (F.col("id") != F.col("rep")))
    every = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key")
    return every.filter("a < b").select("a", "b").distinct()


def _unlinked(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    roots = small(roots)
    for c, own in (("a", "u"), ("b", "v")):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(own)), c, "left")
    return pairs.filter(F.coalesce("u", "a") != F.coalesce("v", "b")).select("a", "b")


def _apart(met: DataFrame, roots: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, own, out): the lines of large buckets that hold several components, their component, and whether it isn't the commonest's somewhere."""
    own = small(numbered(roots.select(F.col("node").alias("id"), F.col("root").alias("own")), rows(roots)))
    named = met.filter(F.col("size") > ALL_PAIRS).select("key", "id", "rep").join(own, "id", "left")
    named = named.join(own.select(F.col("id").alias("rep"), F.col("own").alias("reps")), "rep", "left")
    named = named.select("key", "id", F.coalesce("own", "id").alias("own"), F.coalesce("reps", "rep").alias("reps"))
    named = scratch.save(named, f"{name}-named")
    mixed = _short(named.filter("own <> reps").select("key").distinct(), rows(named), scratch, f"{name}-mixed")
    about = named.join(mixed, "key", "left_semi").groupBy("id", "own").agg(F.max(F.col("own") != F.col("reps")).alias("out"))
    return scratch.save(about, f"{name}-apart")


def _linked(links: DataFrame, roots: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The components of further links among components."""
    return components(links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), scratch, name) if rows(links) else roots


def line_components(lines: DataFrame, scratch: Scratch, measure, keys: DataFrame | None = None, fetch=None) -> DataFrame:
    """(id, root) for linked lines other than the roots of their components.

    ``lines`` are (id, line) and may repeat: only those that meet others are made distinct, and
    the rest is never exchanged. ``keys`` are theirs, if known; ``fetch`` gets distinct
    lines (id, line, n) by a table of ids.
    """
    keys = measure.keyed(lines, runs.COARSE, scratch, "coarse-keys") if keys is None else keys
    met = _meetings(keys, scratch, "coarse")
    ids, seen = met.select("id").distinct(), Observation()
    lines = fetch(ids) if fetch else distinct(lines.join(_short(ids, rows(met), scratch, "ids"), "id", "left_semi"))
    lines = scratch.save(lines.observe(seen, F.max(F.length("line")).alias("longest")), "met-lines")
    longest = seen.get["longest"] or 0
    sketches = measure.sketched(lines)
    sketches = None if sketches is None else scratch.save(sketches, "sketches")
    links = _verify(scratch.save(_stars(met), "pairs"), lines, measure, sketches, longest)
    roots = components(scratch.save(links, "links"), scratch, "coarse")

    # the other pairs of small buckets, unless linked by now; lines of large buckets that aren't in one component are told apart by longer bands
    pairs, about, fine = _others(met), _apart(met, roots, scratch, "coarse"), None
    if rows(about):
        rest = lines.join(small(numbered(about.select("id"), rows(about))), "id", "left_semi")
        fine = _meetings(measure.keyed(rest, runs.FINE, scratch, "fine-keys"), scratch, "fine")
        pairs = pairs.union(_stars(fine)).union(_others(fine)).distinct()
    pairs = scratch.save(_unlinked(pairs, roots), "more-pairs")
    roots = _linked(scratch.save(_verify(pairs, lines, measure, sketches, longest), "more"), roots, scratch, "fine")
    if fine is None:
        return roots

    # what still shares a large bucket without a link meets by prefix filtering
    about = _apart(fine, roots, scratch, "fine")
    if not rows(about):
        return roots
    pairs = _prefix_pairs(lines.join(small(about), "id"), scratch, measure, longest)
    return _linked(scratch.save(_verify(pairs, lines, measure, sketches, longest), "last"), roots, scratch, "last")


def _prefix_pairs(lines: DataFrame, scratch: Scratch, measure, longest: int) -> DataFrame:
    """Pairs (a, b) of different components, one of them ``out``, that may be similar.

    Two sets of n and m shingles and similarity t share at least o = t / (1 + t) * (n + m);
    with shingles ordered from rare to frequent, the first one they share is thus among the
    first n - o + 1 of one and the first m - o + 1 of the other.
    """
    flat = scratch.save(measure.shingles(lines, "id", "own", "out", longest=longest), "flat")
    # written, so that the join can split a frequent digest over tasks
    spread = small(scratch.save(flat.groupBy("h").agg(F.count("*").alias("df")), "spread"))
    order = F.sort_array(F.collect_list(F.struct("df", "h")))
    length = F.col("n") - F.ceil(NUM * F.col("n") / DEN).cast("int") + 1
    ranked = flat.join(spread, "h").groupBy("id", "own", "out").agg(order.alias("all")).withColumn("n", F.size("all"))
    prefix = ranked.select("id", "own", "out", "n", F.posexplode(F.slice("all", F.lit(1), length)).alias("pos", "x"))
    # digests of one line only take their places in the prefix, but meet nothing
    prefix = scratch.save(prefix.filter("x.df > 1").select("id", "own", "out", "n", "pos", "x.h"), "prefix")
    x = prefix.filter("out").select("h", *[F.col(c).alias(f"{c}_a") for c in ("id", "own", "n", "pos")])
    y = prefix.select("h", *[F.col(c).alias(f"{c}_b") for c in ("id", "own", "n", "pos")])
    shared = F.ceil(NUM * (F.col("n_a") + F.col("n_b")) / (NUM + DEN))
    near = (F.col("pos_a") + shared <= F.col("n_a")) & (F.col("pos_b") + shared <= F.col("n_b")) & (F.col("own_a") != F.col("own_b"))
    met = x.join(y, "h").filter(near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def dropped(places: DataFrame, lines: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Of ``places`` (at, id) those of the lines that go: all of a component but the first."""
    linked = roots.select(F.col("node").alias("id"), "root").union(roots.select(F.col("root").alias("id"), "root").distinct())
    repeated = lines.filter("n > 1").select("id")
    alone = repeated.join(linked.select("id"), "id", "left_anti").select("id", F.col("id").alias("root"))
    tied = scratch.save(linked.union(alone), "tied")
    places = scratch.save(places.join(small(tied), "id").select("at", "root"), "places")
    first = _short(places.groupBy("root").agg(F.min("at").alias("keep")), rows(tied), scratch, "first")
    return places.join(first, "root").filter("at <> keep").select("at")


def dedup_lines(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of ``docs`` with deduplicated texts, and n_lines, n_kept (lines with a word)."""
    scratch, between = Scratch(spark), Scratch(spark)
    lines = _lines(docs)
    # texts are split again rather than written: lines that neither meet others nor repeat are never exchanged
    keys = RUNS.keyed(lines.select("id", "line"), runs.COARSE, between, "coarse-keys")
    repeated = scratch.save(keys.filter("n > 1").select("id", "n").distinct(), "repeated")

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = ids.select("id", F.lit(True).alias("met")).union(repeated.select("id", F.lit(False)))
        wanted = small(scratch.save(wanted.groupBy("id").agg(F.max("met").alias("met")), "wanted"))
        found = lines.join(wanted, "id").select("at", "id", F.when(F.col("met"), F.col("line")).alias("line"))
        # digests don't repeat enough for dictionaries
        return distinct(scratch.save(found, "lines", {"parquet.enable.dictionary": "false"}).filter("line is not null"))

    roots = scratch.save(line_components(lines, between, RUNS, keys, fetch), "roots")
    between.keep()
    places = spark.read.parquet(scratch.paths["lines"]).select("at", "id")
    doc, th, gone = fresh(docs, "doc", "th", "gone")
    out = dropped(places, repeated, roots, scratch).groupBy(F.col("at.doc_id").alias(doc), F.col("at.th").alias(th))
    out, seen = out.agg(F.collect_set("at.line_no").alias(gone)), Observation()
    out = scratch.save(out.observe(seen, F.sum(F.size(gone)).alias("most")), "dropped")
    scratch.keep("dropped")
    out = F.broadcast(out) if rows(out) + (seen.get["most"] or 0) <= BROADCAST_ROWS else out
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_kept")]
    marked = docs.join(out, docs["doc_id"].eqNullSafe(out[doc]) & (F.xxhash64(docs["text"]) == out[th]), "left")

    def judged(x: Column) -> Column:
        """Lines with a word, lines that go and the text that stays, from the lines of a text."""
        n = F.size(F.filter(x, lambda line: F.ltrim(line, F.lit(BLANKS)) != ""))
        left = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), out[gone])
        text = F.when(out[gone].isNull(), docs["text"]).otherwise(F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n"))
        return F.struct(n.cast("long").alias("n"), F.coalesce(F.size(out[gone]), F.lit(0)).alias("gone"), text.alias("text"))

    found = F.when(docs["text"].isNotNull(), let(F.split(docs["text"], "\n"), judged))
    (new,) = fresh(docs, "judged")
    n_lines = F.coalesce(F.col(f"`{new}`.n"), F.lit(0).cast("long"))
    return marked.select(*[docs[c] for c in names if c != "text"], found.alias(new)).select(
        *[F.col(f"`{new}`.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
        n_lines.alias("n_lines"),
        (n_lines - F.coalesce(F.col(f"`{new}`.gone"), F.lit(0))).alias("n_kept"),
    )
