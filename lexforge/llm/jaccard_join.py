"""N-gram Jaccard join (operator 2): exact, by partitioning the universe of shingles and the pigeonhole principle.

Two sets of x and y shingles with Jaccard similarity t or more differ in at most H = (x + y)(1 - t)/(1 + t) shingles.
Shingle hashes are cut into the segments of a size band (`band_edges`), the same for both sets; each difference spoils
one segment, so of more than H segments one must be equal. A document indexes the hash of the subset it has in a segment.

Allocation by cost, for each document: an empty segment's list would hold most of the band, so it gets no signature;
non-empty ones are taken in the order of segments until there are H + 1 and a reserve (`reserve`) of them. Of a pair, the
document that stops first has H + 1 + reserve signatures before that place, of which at most H are spoilt: so the
pair shares reserve + 1 signatures at least, and pairs that share fewer are dropped before verification. A signature
in over `LONG` documents is skipped while the reserve covers it, with the floor lowered by one. Should a document have
fewer non-empty segments than that (seldom), all are cut anew by another seed.

Documents whose reserve is used up that way (short texts around a common passage, large groups of near copies) are
allotted the smallest segments there are, single shingles, all of them, in an index of their own. There a pair that shares
a short list is a candidate by it, and any other has its whole overlap in long lists, 3/4 of each document at least.
Of a document's l long shingles, rarest first, l - 3n/4 + 1 are enough to meet. Each list's pivot, the document with the
largest share of long shingles, is measured against all of the list; components contract, and then a document outside
its list's largest component is measured against those of other components that the pivot leaves: with o long
shingles in common with the pivot and e others, two documents share min(o, o') + min(e, e') at most. Profiles (n, o, e)
meet before documents do, so equal profiles cost one comparison.

One-deletion neighbourhoods aren't built: one buys two units of difference for 1 + |segment| signatures; at two to three
shingles a segment two exact subsets are cheaper (measured, see README).

Signatures travel packed: each chunk of texts sends one row of bytes to a bucket, 6 bytes of signature and the ids' byte
planes. A bucket's lists are found by sorting in numpy, block by block; a list that outgrows LONG streams out, so memory
doesn't grow with a signature's documents. Candidates are verified on whole sets of 64-bit shingle hashes:
100 * common >= 75 * union, in integers; before that, pairs go whose sets differ too much by 1,024 bits of each.

Defined results: null and empty texts and texts without words have no set and link with nothing; equal sets are one
class, found by digest and represented by its smallest doc_id. Where ids repeat or are null, rows are joined as rows:
each row keeps its own n_shingles, rows of one id are one node of the graph, and a null id is a node without a name, so
component_id is the smallest id in reach, null where there is none. An empty table gives no rows; extra columns aren't
read, whatever their names; ties don't matter, as components don't depend on order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, shuffle_partitions
from .bytesnp import U64, _mix, chunks, return_memory, shingle_sets
from .components import components
from .joins import skew_left_join, without_ids

LONG = 32
SMALL_BAND = 300
CHUNK = 1 << 19
#: Signatures a bucket holds before it settles its lists.
BLOCK = 2_000_000
#: Pairs of short lists made at a time.
PAIRS = 250_000
#: Bits that tell which shingles a set can't have: a bit of one set that another lacks is a difference.
BITS = 1024


def band_edges(limit: int = 1 << 40) -> np.ndarray:
    """Bands grow by (4/3)^2, so a set within 3/4 of another lies in its band or the next."""
    edges = [1]
    while edges[-1] < limit:
        edges.append(max(edges[-1] + 1, edges[-1] * 16 // 9))
    return np.array(edges, dtype=np.int64)


def reserve(need: int) -> int:
    return max(4, need // 8)


def _segment_signatures(s: np.ndarray, upper: int, salt: int) -> np.ndarray:
    """Signatures of the non-empty segments of one sorted set, in the order of segments.

    A band that ends at `upper` has 5/8 of a segment for each shingle of its largest set, small bands one for each
    possible shingle; so H + 1 + reserve non-empty ones are there but for odds of about 1e-12 a document.
    """
    tag = U64((salt * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)
    if upper <= SMALL_BAND:
        return _mix(s ^ tag)
    seg = ((s >> U64(32)) * U64(upper * 5 // 8)) >> U64(32)
    starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    sums = np.add.reduceat(_mix(s + U64(0x632BE59BD9B4E019)), starts)
    return _mix(sums ^ (seg[starts] * U64(0x9E3779B97F4A7C15)) ^ tag)


def signatures(s: np.ndarray, edges: np.ndarray, seed: int = 0) -> list[np.ndarray] | None:
    """Signatures of one set: in its own band, and in the one below if it reaches there; None if segments are too few."""
    n = len(s)
    if seed:
        s = np.sort(_mix(s + U64(seed)))
    k = int(np.searchsorted(edges, n, side="right")) - 1
    out = []
    for band in (k, k - 1):
        if band < 0:
            continue
        upper = int(edges[band + 1])  # first size above the band
        if band == k:
            need = n // 3 + 1
        elif 3 * n > 4 * (upper - 1):
            continue
        else:
            need = (upper - 1 + n) // 7 + 1
        sig = _segment_signatures(s, upper, band)
        most = need + reserve(need)
        if len(sig) < min(most, n):
            return None
        out.append(sig[:most])
    return out


def least_reserve(n):
    """The reserve that a set of n, or one within 3/4 of it, has at least; n is a column."""
    small = F.ceil(n * 3 / 4)
    return F.least(F.greatest(F.lit(4), F.floor((F.floor(small / 3) + 1) / 8)), small - F.floor(small / 3) - 1)


def _digest_rows(width: int):
    def run(batches):
        return_memory()
        for b in batches:
            for at, data, off in chunks(b.column(1), CHUNK):
                s, bounds = shingle_sets(data, off, width)
                n = np.diff(bounds)
                sums = np.zeros((2, len(s) + 1), U64)
                np.cumsum(_mix(s + U64(1)), dtype=U64, out=sums[0, 1:])
                np.cumsum(_mix(s ^ U64(0xA0761D6478BD642F)), dtype=U64, out=sums[1, 1:])
                d = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
                bits = np.zeros((len(n), BITS), dtype=bool)
                bits[np.repeat(np.arange(len(n)), n), (s >> U64(20)) % U64(BITS)] = True
                words = np.packbits(bits, axis=1).view(np.int64)
                offsets = np.arange(0, words.size + 1, BITS // 64, dtype=np.int32)
                yield pa.record_batch([b.column(0).slice(at, len(n)).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.ravel()))], names=["doc_id", "n_shingles", "d1", "d2", "bits"])

    return run


DIGESTS = "doc_id long, n_shingles long, d1 long, d2 long, bits array<long>"


def _packed(sig: np.ndarray, doc: np.ndarray, buckets: int, wide: int):
    """Rows (bucket, sigs, docs): the `wide` high bytes of each signature, and the ids' byte planes."""
    at = ((sig & U64(0xFFFFFFFF)) % U64(buckets)).astype(np.int32)
    order = np.argsort(at, kind="stable")
    names, first = np.unique(at[order], return_index=True)
    ends = [*first[1:].tolist(), len(at)]
    high = sig[order].view(np.uint8).reshape(-1, 8)[:, 8 - wide :]
    ids = doc[order].view(np.uint8).reshape(-1, 8)
    spans = list(zip(first.tolist(), ends, strict=True))
    return pa.record_batch([pa.array(names), pa.array([high[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([ids[a:b].T.tobytes() for a, b in spans], pa.binary())], names=["bucket", "sigs", "docs"])


def _unpacked(sigs: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(docs) // 8
    ids = np.ascontiguousarray(np.frombuffer(docs, np.uint8).reshape(8, n).T).view(np.int64).ravel()
    wide = len(sigs) // n
    high = np.zeros((n, 8), np.uint8)
    high[:, 8 - wide :] = np.frombuffer(sigs, np.uint8).reshape(n, wide)
    return high.view(np.int64).ravel(), ids


PACKED = "bucket int, sigs binary, docs binary"


def _signature_rows(width: int, buckets: int, seed: int):
    """Packed signatures; bucket -1 has the ids of documents with too few segments."""

    def run(batches):
        return_memory()
        edges = band_edges()
        for b in batches:
            for at, data, off in chunks(b.column(1), CHUNK):
                s, bounds = shingle_sets(data, off, width)
                ids = b.column(0).slice(at, len(off) - 1).to_numpy(zero_copy_only=False)
                sig, doc, poor = [], [], []
                for r in np.flatnonzero(np.diff(bounds)).tolist():
                    found = signatures(s[bounds[r] : bounds[r + 1]], edges, seed)
                    if found is None:
                        poor.append(ids[r])
                        continue
                    sig += found
                    doc += [(ids[r], len(x)) for x in found]
                if sig:
                    yield _packed(np.concatenate(sig), np.repeat(*(np.array(x, np.int64) for x in zip(*doc, strict=True))), buckets, 6)
                if poor:
                    bad = np.array(poor, np.int64)
                    yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([bytes(6 * len(bad))], pa.binary()), pa.array([bad.view(np.uint8).reshape(-1, 8).T.tobytes()], pa.binary())], names=["bucket", "sigs", "docs"])

    return run


def _single_rows(width: int, buckets: int):
    """Every shingle of a set as a segment of its own."""

    def run(batches):
        return_memory()
        for b in batches:
            for at, data, off in chunks(b.column(1), CHUNK):
                s, bounds = shingle_sets(data, off, width)
                if len(s):
                    ids = b.column(0).slice(at, len(off) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                    yield _packed(s, np.repeat(ids, np.diff(bounds)), buckets, 8)

    return run


def _set_rows(width: int):
    def run(batches):
        return_memory()
        for b in batches:
            for at, data, off in chunks(b.column(1), CHUNK):
                s, bounds = shingle_sets(data, off, width)
                sets = pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), pa.array(s.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.record_batch([b.column(0).slice(at, len(off) - 1), sets], names=["doc", "shingles"])

    return run


LISTS = "kind int, a long, b long, n long"


def _list_rows(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray):
    for at in range(0, len(a), 100_000):
        cut = slice(at, at + 100_000)
        yield pa.record_batch([pa.array(np.full(len(a[cut]), kind, np.int32)), pa.array(a[cut]), pa.array(b[cut]), pa.array(n[cut])], names=["kind", "a", "b", "n"])


def _short_pairs(doc: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Rows of kind 0, (a, b, lists that both are in), of lists with 2 to LONG documents, sorted within each."""
    for k in np.unique(sizes).tolist():
        of_size = starts[sizes == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, PAIRS // len(i))
        for at in range(0, len(of_size), step):
            rows = doc[of_size[at : at + step, None] + np.arange(k)]
            a, b = rows[:, i].ravel(), rows[:, j].ravel()
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            yield from _list_rows(0, a[new], b[new], np.diff(np.concatenate([new, [len(a)]])))


def _meet(batches):
    """Lists of a partition's packed rows: kind 0, pairs of the short ones; kind 1, (signature, document) of the long
    ones; kind 2, documents of bucket -1."""
    return_memory()
    sigs, docs, held, long = [], [], 0, np.zeros(0, np.int64)

    def settle(last: bool):
        nonlocal sigs, docs, held, long
        sig, doc = np.concatenate(sigs), np.concatenate(docs)
        if not len(sig):
            return
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])])
        sig, doc = sig[new], doc[new]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(sig)]]))
        is_long = (sizes > LONG) | np.isin(sig[starts], long)
        long = np.union1d(long, sig[starts[is_long]])
        out = np.repeat(is_long, sizes)
        yield from _list_rows(1, sig[out], doc[out], np.ones(int(out.sum()), np.int64))
        if last:
            short = ~is_long & (sizes > 1)
            yield from _short_pairs(doc, starts[short], sizes[short])
            sigs, docs = [], []
        else:
            sigs, docs = [sig[~out]], [doc[~out]]
        held = int((~out).sum())

    limit = BLOCK
    for b in batches:
        for bucket, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sig, doc = _unpacked(x, y)
            if bucket < 0:
                yield from _list_rows(2, doc, doc, np.ones(len(doc), np.int64))
                continue
            sigs.append(sig)
            docs.append(doc)
            held += len(sig)
        if held > limit:
            yield from settle(False)
            limit = max(BLOCK, 2 * held)
    if sigs:
        yield from settle(True)


def _copies(deg):
    return F.floor((deg - 1) / 256).cast("int")


def common_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common) of distinct pairs, from sets (doc, shingles). A document in many pairs is copied, one copy for each
    256 of them, on either side, so no task holds all of a document's pairs."""
    for side, other in (("a", "b"), ("b", "a")):
        deg = pairs.groupBy(side).agg(F.count(F.lit(1)).alias(f"deg_{side}"))
        pairs = pairs.join(deg, side).withColumn(f"salt_{side}", F.pmod(F.xxhash64(other), _copies(F.col(f"deg_{side}")) + 1).cast("int"))
    sides = []
    for side in "ab":
        deg = pairs.select(side, F.col(f"deg_{side}").alias("deg")).distinct()
        spread = sets.join(deg, F.col("doc") == F.col(side)).select(side, F.col("shingles").alias(f"s_{side}"), F.explode(F.sequence(F.lit(0), _copies(F.col("deg")))).alias(f"salt_{side}"))
        sides.append(spread)
    both = pairs.select("a", "b", "salt_a", "salt_b").join(sides[0], ["a", "salt_a"]).select("a", "b", "salt_b", "s_a").join(sides[1], ["b", "salt_b"])
    return both.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("common"))


class _Join:
    """One run: the documents that represent their classes, their sizes, and the tables written on the way."""

    def __init__(self, rows: DataFrame, width: int, percent: int, scratch: Scratch):
        self.rows, self.width, self.percent, self.scratch, self.spark = rows, width, percent, scratch, rows.sparkSession

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return self.scratch.write(df, f"jj-{name}")

    def linked(self, common, sizes):
        return (100 + self.percent) * common >= self.percent * sizes

    def only(self, rows: DataFrame, ids: DataFrame) -> DataFrame:
        """Rows whose first column is one of the ids (one column, written before): broadcast only after counting them."""
        want = ids.select(F.col(ids.columns[0]).alias("_want"))
        want = F.broadcast(want) if ids.count() <= 1_000_000 else want.hint("merge")
        return rows.join(want, F.col(rows.columns[0]) == F.col("_want"), "left_semi")

    def classes(self, digests: DataFrame) -> DataFrame:
        """doc_id, n_shingles, class_id of all documents with a set; sets `reps` and `sizes`."""
        self.bits = digests.select(F.col("doc_id").alias("doc"), "bits")
        full = digests.filter("n_shingles > 0").select("doc_id", "n_shingles", F.struct("n_shingles", "d1", "d2").alias("key"))
        classes = self.write(full.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")), "classes")
        self.total = full.count()
        member = self.write(skew_left_join(full, classes, "key", "copies", self.total).select("doc_id", "n_shingles", "class_id"), "members")
        others = self.write(member.filter("doc_id <> class_id").select("doc_id"), "others")
        self.reps = without_ids(self.rows, others)
        self.sizes = classes.select(F.col("class_id").alias("doc"), F.col("key.n_shingles").alias("n"))
        self.n_all = classes.agg(F.sum("key.n_shingles")).first()[0] or 0
        return member

    def lists(self, packed, name: str) -> DataFrame:
        """Rows of LISTS from a function of the number of buckets that gives packed rows."""
        parts = max(shuffle_partitions(self.spark), -(-self.n_all // BLOCK))
        return self.write(packed(8 * parts).repartition(parts, "bucket").mapInArrow(_meet, LISTS), name)

    def used(self, lists: DataFrame, name: str) -> DataFrame:
        """doc, n and the number of its signatures in long lists."""
        long = lists.filter("kind = 1").groupBy(F.col("b").alias("doc")).agg(F.count(F.lit(1)).alias("long"))
        return self.write(self.sizes.join(long, "doc", "left").select("doc", "n", F.coalesce("long", F.lit(0)).alias("long")), name)

    def listed_pairs(self, lists: DataFrame, used: DataFrame, enough) -> DataFrame:
        """Pairs of the short lists that share as many signatures as a true pair has to (`enough`)."""
        pairs = lists.filter("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("shared"))
        for side in "ab":
            pairs = pairs.join(used.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col("long").alias(f"long_{side}")), side)
        return pairs.filter(enough & (4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b"))).select("a", "b")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """(a, b) of the pairs that link, on whole sets. Those whose bits differ too much go before sets are made."""
        every = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        bits = self.only(self.bits, self.write(every(pairs), f"{name}-all-ids"))
        for side in "ab":
            known = bits.join(self.sizes, "doc").select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
            pairs = pairs.join(known, side)
        lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, k: s + k)
        most = F.least(F.col("n_a") - lacks("bits_a", "bits_b"), F.col("n_b") - lacks("bits_b", "bits_a"))
        pairs = self.write(pairs.filter(self.linked(most, F.col("n_a") + F.col("n_b"))).select("a", "b"), f"{name}-near")
        ids = self.write(every(pairs), f"{name}-ids")
        sets = self.write(self.only(self.reps, ids).mapInArrow(_set_rows(self.width), "doc long, shingles array<long>"), f"{name}-sets")
        found = common_of(pairs, sets)
        for side in "ab":
            found = found.join(self.sizes.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}")), side)
        return self.write(found.filter(self.linked(F.col("common"), F.col("n_a") + F.col("n_b"))).select("a", "b"), name)

    def labels(self, *edges: DataFrame) -> DataFrame:
        every = edges[0]
        for e in edges[1:]:
            every = every.unionByName(e)
        return self.write(components(every, "a", "b"), "labels")

    def links(self) -> DataFrame:
        """node, component over the representatives."""
        reps, width = self.reps, self.width
        for seed in range(64):
            lists = self.lists(lambda buckets, seed=seed: reps.mapInArrow(_signature_rows(width, buckets, seed), PACKED), "lists")
            if not lists.filter("kind = 2").limit(1).count():
                break
        else:
            raise RuntimeError("no seed gives every set enough segments")
        used = self.used(lists, "used")
        floors = [least_reserve(F.col(f"n_{side}")) + 1 - F.col(f"long_{side}") for side in "ab"]
        pairs = self.listed_pairs(lists, used, F.col("shared") >= F.least(*floors))
        # Documents whose reserve the long lists use up: all of their shingles.
        spent = self.write(used.filter(F.col("long") > least_reserve(F.col("n"))).select("doc"), "spent")
        again = self.only(reps, spent)
        singles = self.lists(lambda buckets: again.mapInArrow(_single_rows(width, buckets), PACKED), "singles")
        used = self.used(singles, "used-singles")
        most = F.col("shared") + F.least("long_a", "long_b")
        more = self.listed_pairs(singles, used, self.linked(most, F.col("n_a") + F.col("n_b")))
        pairs = self.write(pairs.unionByName(more).distinct(), "pairs")
        edges = [self.verified(pairs, "links")]
        # In long lists pivots come first, then what lies in different components still.
        long = self.long_shingles(singles, used)
        measured = self.to_pivots(long)
        edges.append(measured.filter("linked").select("a", "b"))
        labels = self.labels(*edges)
        more = self.long_rest(long, measured, labels)
        return self.labels(*edges, more) if more.limit(1).count() else labels

    def long_shingles(self, singles: DataFrame, used: DataFrame) -> DataFrame:
        """(sig, doc, n, l, pivot) of the lists where documents meet whose long shingles may hold a whole overlap; l is
        the number of a document's long shingles. Sets `long_sets`."""
        rows = singles.filter("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("doc"))
        rows = rows.join(used.filter(4 * F.col("long") >= 3 * F.col("n")).select("doc", "n"), "doc")
        counts = self.write(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "long-counts")
        rows = rows.join(counts, "sig")
        # Rarest first, in one order for all documents.
        place = Window.partitionBy("doc").orderBy("k", "sig")
        rows = self.write(rows.withColumn("place", F.row_number().over(place)).withColumn("l", F.count(F.lit(1)).over(Window.partitionBy("doc"))).filter(4 * F.col("l") >= 3 * F.col("n")), "long")
        self.long_sets = self.write(rows.groupBy("doc").agg(F.collect_list("sig").alias("shingles")), "long-sets")
        rows = rows.filter(F.col("place") <= F.col("l") - F.ceil(F.col("n") * 3 / 4) + 1).select("sig", "doc", "n", "l")
        pivots = rows.groupBy("sig").agg(F.min_by("doc", F.struct(-F.col("l") / F.col("n"), "n", "doc")).alias("pivot"))
        return self.write(rows.join(pivots, "sig"), "long-lists")

    def to_pivots(self, long: DataFrame) -> DataFrame:
        """(a, b, common, linked) of each document b and the pivots a of its lists, on their long shingles."""
        pairs = self.write(long.filter("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b"), F.col("n").alias("n_b")).distinct(), "pivots")
        sizes = self.sizes.select(F.col("doc").alias("a"), F.col("n").alias("n_a"))
        found = common_of(pairs.select("a", "b"), self.long_sets).join(pairs, ["a", "b"]).join(sizes, "a")
        return self.write(found.select("a", "b", "common", self.linked(F.col("common"), F.col("n_a") + F.col("n_b")).alias("linked")), "measured")

    def long_rest(self, long: DataFrame, measured: DataFrame, labels: DataFrame) -> DataFrame:
        """(a, b) that link, of documents in a long list that lie in different components."""
        to_pivot = measured.select(F.col("a").alias("pivot"), F.col("b").alias("doc"), "common")
        rows = long.join(to_pivot, ["pivot", "doc"], "left").join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left")
        o = F.coalesce("common", "l")  # a pivot has all of its own
        rows = rows.select("sig", "doc", "n", o.alias("o"), (F.col("l") - o).alias("e"), F.coalesce("component", "doc").alias("c"))
        rows = self.write(rows, "open")
        counts = rows.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("k"))
        home = counts.groupBy("sig").agg(F.max_by("c", F.struct("k", -F.col("c"))).alias("home"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        rows = self.write(rows.join(home.drop("parts"), "sig").withColumn("away", F.col("c") != F.col("home")).drop("home"), "parted")
        key = ["sig", "n", "o", "e"]
        profiles = self.write(rows.groupBy(*key).agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.max("away").alias("away")), "profiles")
        mine = profiles.filter("away").select("sig", *(F.col(c).alias(f"{c}_x") for c in ("n", "o", "e", "c1", "c2")))
        most = F.least("o", "o_x") + F.least("e", "e_x")
        apart = ~((F.col("c1") == F.col("c2")) & (F.col("c1") == F.col("c1_x")) & (F.col("c1_x") == F.col("c2_x")))
        near = (4 * F.least("n", "n_x") >= 3 * F.greatest("n", "n_x")) & self.linked(most, F.col("n") + F.col("n_x"))
        meet = profiles.join(mine, "sig").filter(apart & near).select(*key, "n_x", "o_x", "e_x")
        x = rows.filter("away").select("sig", F.col("doc").alias("x"), *(F.col(c).alias(f"{c}_x") for c in ("n", "o", "e", "c")))
        found = x.join(meet, ["sig", "n_x", "o_x", "e_x"]).join(rows.drop("away"), key).filter("c <> c_x")
        pairs = found.select(F.least("doc", "x").alias("a"), F.greatest("doc", "x").alias("b")).distinct()
        done = measured.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = self.write(pairs.join(done, ["a", "b"], "left_anti"), "long-rest")
        common = common_of(pairs, self.long_sets)
        for side in "ab":
            common = common.join(self.sizes.select(F.col("doc").alias(side), F.col("n").alias(f"n_{side}")), side)
        return self.write(common.filter(self.linked(F.col("common"), F.col("n_a") + F.col("n_b"))).select("a", "b"), "long-rest-links")


def _unique_ids(rows: DataFrame, width: int, percent: int, scratch: Scratch, digests: DataFrame | None = None) -> DataFrame:
    """near_duplicates of rows (doc_id, text) with distinct, non-null ids."""
    run = _Join(rows, width, percent, scratch)
    digests = _digests(rows, width, scratch) if digests is None else digests
    member = run.classes(digests)
    by_class = run.links().select(F.col("node").alias("class_id"), "component")
    weights = member.groupBy("class_id").agg(F.count(F.lit(1)).alias("w"))
    classes = weights.join(by_class, "class_id", "left").select("class_id", "w", F.coalesce("component", "class_id").alias("component_id"))
    found = skew_left_join(member, run.write(classes, "components"), "class_id", "w", run.total)
    none = digests.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n_shingles", "class_id", "component_id").unionByName(none)


def _digests(rows: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    return scratch.write(rows.mapInArrow(_digest_rows(width), DIGESTS), "jj-digests")


def _any_ids(rows: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """near_duplicates of rows whose ids repeat or are null: rows are joined under numbers of their own."""
    numbered = scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "jj-rows")
    found = _unique_ids(numbered.select(F.col("row").alias("doc_id"), "text"), width, percent, scratch)
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", "class_id", F.col("component_id").alias("c"))
    found = scratch.write(found.join(numbered.select("row", "doc_id"), "row"), "jj-by-row")
    # Rows of one id are one node: their components join.
    named = found.filter("doc_id IS NOT NULL")
    total = named.count()
    least = scratch.write(named.groupBy("doc_id").agg(F.min("c").alias("m"), F.count(F.lit(1)).alias("k")), "jj-ids")
    edges = skew_left_join(named.select("doc_id", "c"), least, "doc_id", "k", total).select("c", "m").distinct()
    labels = scratch.write(components(edges, "c", "m"), "jj-id-labels")
    by_c = scratch.write(found.groupBy("c").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("w")), "jj-by-component")
    by_c = by_c.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("component", "c"))
    names = by_c.groupBy("root").agg(F.min("id").alias("component_id"))
    by_c = scratch.write(by_c.join(names, "root").select("c", "w", "component_id"), "jj-names")
    class_of = found.groupBy("class_id").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("v"))
    out = skew_left_join(found, by_c, "c", "w", found.count())
    out = skew_left_join(out, scratch.write(class_of, "jj-class-names"), "class_id", "v", found.count())
    return out.select("doc_id", "n_shingles", F.col("name").alias("class_id"), "component_id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id.

    The bands are built for a threshold of 3/4 (percent = 75); a higher one is met by verification. The result is
    written to the shared folder; all tables on the way are deleted.
    """
    if percent < 75:
        raise ValueError("bands are built for a similarity of 75 percent or more")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        digests = _digests(rows, width, scratch)
        odd = digests.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 OR doc_id IS NULL").limit(1).count()
        found = _any_ids(rows, width, percent, scratch) if odd else _unique_ids(rows, width, percent, scratch, digests)
        return scratch.keep(found, "jj-found")
