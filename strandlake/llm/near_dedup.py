"""Near duplicates by HyperMinHash.

A text is the set of its word shingles. Texts with equal sets are one class from the start. Of each class, a signature of
compressed registers is kept: per bucket the least hash, stored as its count of leading zeros and the bits after them.
Bands of registers are keys; classes that share a key are candidates, their registers give an estimate of the Jaccard
similarity that is corrected for chance collisions, and candidates that may reach the threshold are confirmed on the
full sets. Links are then followed to components.

No key's classes are paired with one another at once: each is first paired with two centres of its key, one of them the
class that shares keys with the most others, as an original does with its altered copies. Where the
links so found leave classes of one key in different components, candidates among such classes come from their rarest
shingles, by an exact bound. So groups of thousands of near copies cost a few pairs for each member, a passage that many
texts share makes no pairs of all of them, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, fresh, handed_back, written

#: 32 bands of 5 registers: of pairs at a similarity of 0.8, three in a million share no band.
BANDS, BAND = 32, 5
REGISTERS = BANDS * BAND
#: Sets above SMALL take their registers from rounds of 16 buckets. Smaller ones cannot fill buckets and have each register
#: from a hash of its own; so have sets that may reach the threshold with these, so that such sets share a kind.
SMALL = 64
BUCKET_BITS = 4
ROUNDS = REGISTERS >> BUCKET_BITS
#: Bits that a register keeps after the leading zeros.
MANTISSA = 10
#: Pairs are confirmed on the full sets if their estimate is not more than this below the threshold (five deviations).
SLACK = 0.17

_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_SEEDS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EDGES = np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
_ODD = mixed(np.arange(101, 101 + BAND, dtype=np.uint64)) | np.uint64(1)
_BAND_OF = mixed(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


class Shingler:
    """64-bit hashes of the distinct shingles of a text, ascending."""

    def __init__(self, width: int, hold: int = 200_000):
        self.width, self.hold = width, hold
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.hold:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
        return np.unique(out)


def compressed(least: np.ndarray, bits: int) -> np.ndarray:
    """Registers of hashes of that many bits: the leading zeros, then MANTISSA bits after the first one."""
    length = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    length = np.minimum(length, bits)
    length -= (least >> np.maximum(length - 1, 0).astype(np.uint64) == 0) & (length > 0)  # rounded up to a power of two
    shift = length - 1 - MANTISSA
    after = np.where(shift >= 0, least >> np.maximum(shift, 0).astype(np.uint64), least << np.maximum(-shift, 0).astype(np.uint64))
    return ((bits - length).astype(np.uint16) << np.uint16(MANTISSA)) | (after & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)


def small_registers(hashes: np.ndarray) -> np.ndarray:
    return compressed(mixed(hashes[None, :] ^ _SEEDS[:, None]).min(1) >> np.uint64(BUCKET_BITS), 64 - BUCKET_BITS)


def large_registers(hashes: np.ndarray) -> np.ndarray:
    """ROUNDS times, the hashes are dealt into buckets by their first bits. An empty bucket borrows from the next."""
    rounds = mixed(hashes[None, :] ^ _SEEDS[:ROUNDS, None])
    rounds.sort(axis=1)
    n = len(hashes)
    least = np.empty((ROUNDS, 1 << BUCKET_BITS), np.uint64)
    mask = np.uint64((1 << (64 - BUCKET_BITS)) - 1)
    for r, row in enumerate(rounds):
        at = np.searchsorted(row, _EDGES)
        least[r] = row[at % n]  # past the end, the first hash of the first bucket that has one
    return compressed((least & mask).ravel(), 64 - BUCKET_BITS)


def band_keys(registers: np.ndarray, kind: int) -> np.ndarray:
    rows = registers.reshape(BANDS, BAND).astype(np.uint64)
    return mixed((rows * _ODD).sum(1, dtype=np.uint64) ^ _BAND_OF ^ np.uint64(kind)).view(np.int64)


def signature(hashes: np.ndarray, percent: int = 80) -> tuple[list[int], bytes | None, bytes | None]:
    """Keys, and the registers of the small and the large kind. An empty set has none."""
    keys, small, large = [], None, None
    if len(hashes) and len(hashes) * percent <= SMALL * 100:
        r = small_registers(hashes)
        keys, small = band_keys(r, 1).tolist(), r.tobytes()
    if len(hashes) > SMALL:
        r = large_registers(hashes)
        keys, large = keys + band_keys(r, 2).tolist(), r.tobytes()
    return keys, small, large


def collision_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """That registers of unrelated sets of these sizes agree (Yu and Weber, HyperMinHash, 2017)."""
    x = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    return 0.169919487159739 * 2.0**-MANTISSA * 4 * x / (1 + x) ** 2


def estimated(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (a row per set) and set sizes, without what chance collisions add."""
    chance = collision_chance(n, m)
    return np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)


#: Shingles of more than one in so many rows are frequent; there are no more than that many of them.
FREQUENT = 20_000
#: Rows of one shingle that meet in a task.
SHARE = 256


def _by_rare_shingles(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that may be similar enough: with each set's shingles in order of
    how many of these sets have them, rarest first, two sets at the threshold share one of the first
    n - ceil(percent * n / 100) + 1 of each. Where the first shingle they share stands in either set bounds what they can
    share: no more than what follows there. Altered copies that are each like the original only have the shingles of
    their own changes first and meet late, which is too late; a passage that many texts share comes late too. Of a
    shingle's sets, those outside its most frequent component are held against all, so a large component is not paired
    with itself.

    The counts of the most frequent shingles, FREQUENT rows at most by how they are chosen, are joined by broadcast; the
    rows of another shingle that many sets have are dealt over several tasks.

    ``rest`` has rep, n, component; ``sets`` has rep and hashes."""
    rows = sets.select("rep", F.explode("hashes").alias("h"))
    often = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared-shingles")
    total = rest.agg(F.sum("n")).first()[0] or 0
    bound = max(SHARE, total // FREQUENT)  # no more than ``total / bound`` shingles have more rows than that
    frequent = often.where(F.col("df") > bound).select(F.col("h").alias("_f"), F.col("df").alias("_df"))
    rows = rows.join(F.broadcast(frequent), F.col("h") == F.col("_f"), "left")
    apart = F.when(F.col("_df").isNotNull(), 1 + F.pmod(F.hash("rep"), F.lit(1 << 20))).otherwise(0)  # no row of the other side
    rows = rows.withColumn("_apart", apart).join(often.select("h", "df", F.lit(0).alias("_apart")), ["h", "_apart"], "left")
    rows = rows.select("rep", "h", F.coalesce("_df", "df").alias("df")).where("df IS NOT NULL")
    ordered = rows.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("o")).join(rest, "rep")
    unique = F.col("n") - F.size("o")  # these come first and meet no other set
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - unique
    keys = ordered.where(first > 0).select("rep", "n", "component", unique.alias("own"), F.posexplode(F.slice("o", F.lit(1), first.cast("int"))).alias("at", "x"))
    shares = F.ceil(F.col("x.df") / SHARE).cast("int")
    keys = keys.select("x.h", "rep", "n", (F.col("n") - F.col("own") - F.col("at")).alias("left"), "component", shares.alias("shares"), F.pmod(F.hash("rep"), shares).alias("share"))
    keys = written(keys, "rare-shingles")
    sizes = keys.groupBy("h", "shares", "component").agg(F.count(F.lit(1)).alias("many"))
    main = sizes.groupBy("h", "shares").agg(F.max_by("component", F.struct("many", "component")).alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1")
    each = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    keys = written(keys.join(main.select("h", "main", each), ["h", "share"]), "rare-shingles-split")
    x = keys.where("component <> main").select("h", "share", F.col("rep").alias("_a"), F.col("n").alias("_n"), F.col("left").alias("_l"), F.col("component").alias("_x"))
    y = keys.select("h", each, F.col("rep").alias("_b"), F.col("n").alias("_m"), F.col("left").alias("_r"), F.col("component").alias("_y"))
    most = F.least("_l", "_r")
    reach = most * 100 >= (F.col("_n") + F.col("_m") - most) * percent
    return x.join(y, ["h", "share"]).where((F.col("_x") != F.col("_y")) & reach).select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()


@dataclass(frozen=True)
class Links:
    """members: doc_id, text_hash, n_shingles, digest of every row; classes: of every non-empty set its digest, rep (a number
    of its own), first (its smallest doc_id, null if it has none), text_hash (of a row with that id) and component (a rep)."""

    members: DataFrame
    classes: DataFrame


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def signatures(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (null for an empty set), keys, small and large registers."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(shingle)
        for batch in batches:
            n, digest, keys, small, large = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                h = cut(text)
                k, s, lg = signature(h, percent)
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                keys.append(k)
                small.append(s)
                large.append(lg)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(small, pa.binary()), pa.array(large, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "digest", "keys", "small", "large"],
            )
        handed_back()

    bounded_batches(docs.sparkSession)
    return _rows(docs, id_col, text_col).mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, digest binary, keys array<long>, small binary, large binary")


def _fit(n: Column, m: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _likely(pairs: DataFrame, registers: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose registers do not rule the similarity out."""
    side = lambda x: registers.select(*[F.col(c).alias(f"{c}_{x}" if c != "rep" else x) for c in ("rep", "n", "small", "large")])
    least = percent / 100 - SLACK
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    one = F.col("small_a").isNotNull() & F.col("small_b").isNotNull()
    both = both.select("a", "b", "n_a", "n_b", F.when(one, F.col("small_a")).otherwise(F.col("large_a")).alias("x"), F.when(one, F.col("small_b")).otherwise(F.col("large_b")).alias("y"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            n, m = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(estimated(x, y, n, m) >= least)) for c in batch.columns[:2]], names=["a", "b"])

    return both.where("x IS NOT NULL AND y IS NOT NULL").mapInArrow(keep, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough; ``sets`` has rep and its hashes."""
    a, b = (sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(a, "a").join(b, "b").where(both * 100 >= (F.size("ha") + F.size("hb") - both) * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of the nodes that edges (a, b) join: labels fall to the least of the
    neighbours', then to the label of their label, until none changes. Labels stay in Spark."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        low = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        new = written(low.join(jump, "low", "left").select("node", "old", F.least("low", F.coalesce("far", "low")).alias("component")), "labels")
        labels = new.select("node", "component")
        if not new.where("old <> component").head(1):
            return labels


def link(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> Links:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Words are runs of anything but ASCII white space, with A-Z in lower case. With fewer words than a shingle has, the
    whole sequence is one. Null and empty texts have no set and are linked with nothing. Sets stand for themselves, not
    for ids, so rows without an id, rows that repeat an id with another text and repeated rows are linked like others.
    Other columns are not looked at; an empty table has no classes.
    """
    signed = written(signatures(docs, shingle, percent, id_col, text_col), "signatures")
    members = signed.select("doc_id", "text_hash", "n_shingles", "digest")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    classes = members.where("digest IS NOT NULL").groupBy("digest").agg(first)
    classes = classes.select("digest", F.monotonically_increasing_id().alias("rep"), F.col("first.doc_id").alias("first"), F.col("first.text_hash").alias("text_hash"))
    classes = written(classes, "classes")
    named = classes.select(F.col("digest").alias("_d"), "rep", F.col("first").alias("_first"), F.col("text_hash").alias("_text"))
    own = signed.join(named, (F.col("digest") == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("text_hash") == F.col("_text")))
    reps = written(own.dropDuplicates(["rep"]).select("rep", F.col("n_shingles").alias("n"), "keys", "small", "large"), "class-signatures")
    registers = reps.select("rep", "n", "small", "large")

    keyed = reps.select("rep", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    crowd = written(keyed.join(shared, "key"), "candidates")
    fame = crowd.groupBy("rep").agg(F.sum("many").alias("fame"))
    crowd = written(crowd.join(fame, "rep").select("key", "rep", "n", "fame"), "candidates-fame")
    one = F.struct("rep", "n")
    centres = crowd.groupBy("key").agg(F.max_by(one, F.struct("fame", (-F.col("rep")).alias("r"))).alias("c0"), F.min(one).alias("c1"))
    star = crowd.join(centres, "key").select("rep", "n", F.explode(F.array_distinct(F.array("c0", "c1"))).alias("c"))
    star = star.where((F.col("rep") != F.col("c.rep")) & _fit(F.col("n"), F.col("c.n"), percent))
    star = star.select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct()
    likely = written(_likely(star, registers, percent), "likely")

    def sets_of(ids: DataFrame) -> DataFrame:
        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut = Shingler(shingle)
            for batch in batches:
                found = [cut(x) for x in batch.column(2).to_pylist()]
                digests = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["digest", "hashes"])
            handed_back()

        wanted = written(named.join(ids, "rep", "left_semi"), "wanted-classes")
        texts = _rows(docs, id_col, text_col).join(wanted.select("_first", "_text"), (F.col("text_hash") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
        made = texts.mapInArrow(hashed, "digest binary, hashes array<long>").join(wanted.select("_d", "rep"), F.col("digest") == F.col("_d"))
        return written(made.select("rep", "hashes").dropDuplicates(["rep"]), "sets")

    def ends(pairs: DataFrame) -> DataFrame:
        return written(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted")

    edges = written(_confirmed(likely, sets_of(ends(likely)), percent), "links")
    labels = components(edges)
    label = F.coalesce("component", "rep")
    crowd = crowd.select("key", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", label.alias("component"))
    crowd = written(crowd, "residue")
    split = crowd.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = written(crowd.join(split, "key", "left_semi").select("rep", "n", "component").distinct(), "residue-classes")
    if rest.head(1):
        more = _by_rare_shingles(rest, sets_of(rest.select("rep")), percent)
        more = written(_likely(more.join(likely, ["a", "b"], "left_anti"), registers, percent), "likely-rest")
        if more.head(1):
            edges = edges.unionByName(written(_confirmed(more, sets_of(ends(more)), percent), "links-rest"))
            labels = components(edges)
    labelled = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "rep", "first", "text_hash", label.alias("component"))
    return Links(members, written(labelled, "class-components"))


def deduplicated(links: Links) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, null if none has an id) and kept (doc_id is
    component_id). Rows that repeat an id and text are judged alike. A row without an id is kept only if no row that it is
    linked with has one; a row without a set only stands for itself."""
    smallest = links.classes.groupBy("component").agg(F.min("first").alias("least"))
    named = links.classes.join(smallest, "component").select(F.col("digest").alias("_d"), "least")
    rows = links.members.join(named, F.col("digest") == F.col("_d"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def single(docs: DataFrame, links: Links, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but one row of each component alone: the one with the smallest id, rows without an id last, and
    of different texts of that id the one with the smallest hash. Of rows that repeat its id and text one stays, whichever.
    Rows without a set all stay. The rows that go are few, so they are what the rows are held against."""
    order = F.struct(F.col("first").isNull().alias("none"), "first", "text_hash", "digest")
    best = links.classes.groupBy("component").agg(F.min(order).alias("best"))
    chosen = links.classes.join(best, "component").where(F.col("best.digest") == F.col("digest")).select(F.col("digest").alias("_d"), "first", F.col("text_hash").alias("_t"))
    rows = links.members.where("digest IS NOT NULL").join(chosen, (F.col("digest") == F.col("_d")) & (F.col("text_hash") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    keys = rows.groupBy("doc_id", "text_hash").agg(F.max(F.col("_d").isNotNull()).alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1")
    gone, hashed = fresh(docs, "_gone"), fresh(docs, "_text")
    keys = written(keys.select(F.col("doc_id").alias(gone), F.col("text_hash").alias(hashed), "stays"), "duplicates")
    same = (F.xxhash64(F.col(text_col).cast("string")) == F.col(hashed)) & F.col(id_col).cast("long").eqNullSafe(F.col(gone))
    kept = docs.join(keys.select(gone, hashed), same, "left_anti")
    again = keys.where("stays").select(gone, hashed)
    if again.head(1):
        kept = kept.unionByName(docs.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
    return kept
