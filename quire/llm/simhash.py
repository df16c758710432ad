"""Operator 10: SimHash near-dedup by the generalised pigeonhole, with unequal thresholds for groups of bits."""

from __future__ import annotations

import hashlib
import math
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, forest, table
from .components import components

BITS = 64
#: Fingerprints, in order of their hash, from which bit correlations and candidate counts are estimated.
SAMPLE = 4096
#: Rows of a probed bucket that one task compares; larger buckets are split into pairs of chunks.
CHUNK = 4096
#: Estimated cost of a probe row against that of a compared pair.
ROW_COST = 1500.0
#: Odd factors that make other hashes of one.
MIXERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Bins of a sketch, a power of two; one byte each.
BINS = 512
#: Bands of least hashes and rows of a band. Sets of similarity s share a band but for a chance of (1 - s**ROWS)**BANDS: 5e-6 at 0.8.
BANDS, ROWS = 40, 6
#: Factors that put shingles in order, one an order.
ORDERS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Smaller sets that are not equal are less alike than 0.8.
LEAST_SET = 4
#: Rows, and bytes of sets, of a group that one task compares; larger groups are split into pairs of chunks.
SKETCHES, SET_BYTES = 1024, 1 << 25
#: Pairs whose estimated similarity is lower by this, over five standard errors, are not compared by their sets.
DOUBT = 0.1


# --- fingerprints -----------------------------------------------------------------------------


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of each n-word shingle, repeats included; of all words if they are fewer; none for no word."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z alone is lowered, and the six ASCII spaces alone split
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(line, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], 42) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes set."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, n: int = 3) -> int:
    return majority(shingle_hashes(text, n))


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles."""
    x = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(MIXERS[k])
    return x ^ (x >> np.uint64(29))


def sketch(hashes: np.ndarray) -> bytes:
    """A byte for each of BINS: 0 if no hash falls into the bin, else 1 to 255 from the smallest that does."""
    out = np.zeros(BINS, np.uint8)
    if len(hashes):
        low = np.sort(hashes)
        at = (low >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        out[at[first]] = low[first] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def set_digest(hashes: np.ndarray) -> bytes:
    """16 bytes that tell sets of hashes apart; repeats and order don't count."""
    return hashlib.blake2b(np.unique(hashes).tobytes(), digest_size=16).digest()


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the sets behind rows of sketches; 1 for two empty ones.

    Of bins that either set fills, those where the smallest hashes agree. The standard error is at most
    0.018 at 0.8 (long texts), and less for texts of few shingles.
    """
    same = ((x == y) & (x > 0)).sum(axis=1)
    filled = ((x > 0) | (y > 0)).sum(axis=1)
    return np.where(filled > 0, same / np.maximum(filled, 1), 1.0)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, each in order; 1 for two empty ones."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    return both / (len(x) + len(y) - both)


def _fingerprinted(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, fp, sig) of documents: fingerprints of n-word shingles, and no signature."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(x, n) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(fps), pa.array([b""] * len(fps), pa.binary())], names=["doc_id", "fp", "sig"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, sig binary")


def lows(hashes: np.ndarray) -> bytes:
    """Eight bytes a band, of BANDS: a hash of the least hashes of a set of shingles by ROWS orders; none for sets of under LEAST_SET.

    By each order the least hashes of two sets are equal with their similarity as the chance.
    """
    if len(hashes) < LEAST_SET:
        return b""
    low = np.full(len(ORDERS), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        x = hashes[i : i + 1024, None] * ORDERS
        low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(ROWS, BANDS):
        out = (out ^ row) * np.uint64(MIXERS[0])
        out ^= out >> np.uint64(29)
    return out.tobytes()


def _profiled(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp, sig, bands) of documents, all of the set of their five-word shingles.

    digest tells sets apart, fp is the set's fingerprint, sig two more by other hashes, and bands the hashes of lows().
    """

    def profile(text):
        fives = np.unique(shingle_hashes(text, 5))
        return set_digest(fives), majority(fives), b"".join(majority(mixed(fives, k)).to_bytes(8, "little") for k in (0, 1)), lows(fives)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            digest, fp, sig, bands = zip(*map(profile, batch.column("text").to_pylist())) if batch.num_rows else ((), (), (), ())
            fps = pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(digest, pa.binary()), fps, pa.array(sig, pa.binary()), pa.array(bands, pa.binary())],
                names=["doc_id", "digest", "fp", "sig", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, fp long, sig binary, bands binary")


def _drawn(docs: DataFrame) -> DataFrame:
    """(node, digest, sketch, hashes) of documents, of the set of their five-word shingles; hashes are the set, in order."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [np.unique(shingle_hashes(x, 5)) for x in batch.column("text").to_pylist()]
            made = [pa.array([f(x) for x in sets], pa.binary()) for f in (set_digest, sketch, np.ndarray.tobytes)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *made], names=["node", "digest", "sketch", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, digest binary, sketch binary, hashes binary")


# --- plan: groups of bits and their thresholds ----------------------------------------------------


def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size, correlated bits together: each group grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(len(sample), 8), axis=1, bitorder="little").astype(float)
    centred = bits - bits.mean(axis=0) if len(sample) else np.zeros((1, BITS))
    spread = np.sqrt((centred**2).sum(axis=0))
    spread[spread == 0] = 1.0
    corr = np.abs(centred.T @ centred / spread / spread[:, None])
    free, groups = list(range(BITS)), []
    for g in range(m):
        size = BITS // m + (g < BITS % m)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The bits of each fingerprint as a small number."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def flips(width: int, t: int) -> np.ndarray:
    """All masks of at most t of width bits."""
    from itertools import combinations

    return np.array([sum(1 << i for i in c) for k in range(t + 1) for c in combinations(range(width), k)], np.int64)


def _estimate(sample: np.ndarray, bits: list[int], t: int, n: int) -> float:
    """Cost of threshold t on a group for n fingerprints: probe rows, and pairs within t bits scaled from the sample."""
    if t < 0:
        return 0.0
    rows = 1 if t == 0 else 1 + sum(comb(len(bits), k) for k in range(t + 1))
    v, c = np.unique(values(sample, bits), return_counts=True)
    near = 0.0
    for i in range(0, len(v), 256):
        near += float(((np.bitwise_count(v[i : i + 256, None] ^ v[None, :]) <= t) * (c[i : i + 256, None] * c[None, :])).sum())
    pairs = max(0.0, near - len(sample)) / max(1, len(sample) * (len(sample) - 1)) + comb(len(bits), 0) / 2.0 ** len(bits)
    return n * rows * ROW_COST + pairs * n * n / 2


def allocate(sample: np.ndarray, radius: int, n: int, most: int = 12) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the groups to probe, of least estimated cost.

    Two fingerprints within radius bits agree, in some of m groups, within its threshold, if the
    thresholds add up to radius - m + 1 (a group at -1 is not probed). For each m, dynamic programming over the groups
    finds the thresholds of least cost; the cheapest m wins. Radius 0 needs no probe: equal fingerprints are one class before.
    """
    best = (math.inf, [])
    for m in range(2, min(most, radius + 1) + 1):
        groups = group_bits(sample, m)
        top = radius - m + 1  # the thresholds' sum; a threshold is -1 to 2
        table_: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            costs = {t: _estimate(sample, bits, t, n) for t in (-1, 0, 1, 2)}
            then: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, picked) in table_.items():
                for t, c in costs.items():
                    key = total + t
                    if key not in then or cost + c < then[key][0]:
                        then[key] = (cost + c, [*picked, t])
            table_ = then
        if top in table_ and table_[top][0] < best[0]:
            best = (table_[top][0], [(g, t) for g, t in zip(groups, table_[top][1]) if t >= 0])
    return best[1]


# --- probe and verify ---------------------------------------------------------------------------

ROW = "block int, value long, fp long, sig binary, node long, probe boolean"


def links(classes: DataFrame, radius: int, scratch: Scratch, sig_bits: int | None = None, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that join the same nodes as all links of classes (fp, sig, node): one fingerprint a row.

    Two rows link if their fps differ in at most radius bits and, with sig_bits, their sigs in at most so many.
    Each row goes to the bucket of its value in each probed group, and, as a probe, to the buckets of
    all values within the group's threshold. A bucket's rows are compared in one task, a larger one's
    in pairs of chunks, so that no task holds more than two chunks; only a spanning forest leaves it.
    """
    picked = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    plan = allocate(picked, radius, classes.count())

    def probe(batches):
        import pyarrow as pa

        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for k, (bits, t) in enumerate(plan):
                own = values(fps, bits)
                for flip in flips(len(bits), t).tolist():
                    yield _rows(pa, k, own ^ flip, batch, t > 0)
                if t > 0:
                    yield _rows(pa, k, own, batch, False)

    rows = scratch.keep(classes.select("fp", "sig", "node").mapInArrow(probe, ROW))
    cut = _chunked(rows, ["block", "value"], F.xxhash64("fp", "probe", F.lit(7)), chunk, scratch)
    return cut.mapInArrow(_by_group(["block", "value", "i", "j"], _near(radius, sig_bits)), "a long, b long").distinct()


def _chunked(rows: DataFrame, keys: list[str], spread, chunk: int, scratch: Scratch) -> DataFrame:
    """rows with i and j, sorted by keys, i, j within partitions that hold whole (keys, i, j) groups.

    A group of more than chunk rows is cut into chunks by the hash spread, and each chunk goes to its pairs with all.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    large = scratch.keep(sizes.where("chunks > 1"))
    if large.isEmpty():
        cut = rows.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        parted = rows.join(large, keys, "left").withColumn("_c", F.coalesce("chunks", F.lit(1)))
        parted = parted.withColumn("_i", F.pmod(spread, F.col("_c")).cast("int"))
        to = F.explode(F.expr("transform(sequence(0, _c - 1), x -> struct(least(_i, x) AS i, greatest(_i, x) AS j))"))
        cut = parted.select(*rows.columns, to.alias("_p")).select(*rows.columns, "_p.i", "_p.j")
    return cut.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def _open_groups(rows: DataFrame, chunk: int, most: int, scratch: Scratch) -> DataFrame:
    """rows (component, node, close, hashes, ...) of groups that have a row that isn't close, with i and j as in _chunked.

    Rows that are close are known to be one group already, so of a group's chunks, of at most so many rows and bytes, only pairs with one
    that isn't close are dealt: a row that is close goes to as many tasks as there are chunks of others.
    """

    def chunks(of):
        n, held = F.count_if(of), F.sum(F.when(of, F.length("hashes") + BINS).otherwise(0))
        return F.greatest(F.ceil(n / chunk), F.ceil(held / most)).cast("int")

    sizes = rows.groupBy("component").agg(chunks(F.lit(True)).alias("_n"), chunks(~F.col("close")).alias("_r"), chunks(F.col("close")).alias("_a"))
    sizes = scratch.keep(sizes.where("_r > 0"))
    h, one = F.xxhash64("node"), F.col("_n") == 1
    at = F.when(one, 0).when(F.col("close"), F.col("_r") + F.pmod(h, F.col("_a"))).otherwise(F.pmod(h, F.col("_r"))).cast("int")
    parted = rows.join(sizes, "component").withColumn("_i", at)
    pairs = F.expr(
        "CASE WHEN _n = 1 THEN array(struct(0 AS i, 0 AS j)) WHEN close THEN transform(sequence(0, _r - 1), x -> struct(x AS i, _i AS j)) "
        "ELSE transform(sequence(0, _r + _a - 1), x -> struct(least(_i, x) AS i, greatest(_i, x) AS j)) END"
    )
    cut = parted.select(*rows.columns, F.explode(pairs).alias("_p")).select(*rows.columns, "_p.i", "_p.j")
    return cut.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")


def _by_head(least: float):
    """An Arrow function: members (component, node, sketch, hashes) with close, whether the set of the group's head (_sketch, _hashes) is of a similarity of least or more."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # sets are copied for so many rows at a time
                yield compared(pa, whole.slice(at, 256))

    def compared(pa, batch):
        own, head = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("hashes", "_hashes"))
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch", "_sketch"))
        may = similarity(x, y) >= least - DOUBT
        close = [bool(m) and jaccard(a, b) >= least for m, a, b in zip(may.tolist(), own, head)]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("component", "node", "sketch", "hashes")], pa.array(close, pa.bool_())], names=["component", "node", "sketch", "hashes", "close"])

    return run


def _rows(pa, k, value, batch, probe):
    n = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, k, np.int32)), pa.array(value), batch.column("fp"), batch.column("sig"), batch.column("node"), pa.array(np.full(n, probe))],
        names=[x.split()[0] for x in ROW.split(", ")],
    )


def _by_group(keys: list[str], prepare):
    """An Arrow function over rows sorted by keys: edges (a, b) of each group, from prepare(table)(first row, end)."""

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            k = int(_starts(held, keys)[-1]) if held.num_rows else 0
            if k:  # all but the last group, which may go on
                yield from out(held.slice(0, k))
                held = held.slice(k).combine_chunks()
        if held is not None and held.num_rows:
            yield from out(held)

    def out(t):
        import pyarrow as pa

        edges, found = prepare(t), [np.zeros((2, 0), np.int64)]
        starts = np.append(_starts(t, keys), t.num_rows)
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if e - s > 1 and (pair := edges(s, e)) is not None:
                found.append(pair)
        a, b = np.concatenate(found, axis=1)
        if (apart := a != b).any():
            yield pa.RecordBatch.from_arrays([pa.array(a[apart]), pa.array(b[apart])], names=["a", "b"])

    return run


def _starts(t, keys: list[str]) -> np.ndarray:
    columns = np.stack([t.column(c).to_numpy().astype(np.int64) for c in keys])
    return np.flatnonzero(np.append(True, (columns[:, 1:] != columns[:, :-1]).any(axis=0)))


def _near(radius: int, sig_bits: int | None):
    """Edges of a bucket's forest: fingerprints within radius bits and, with sig_bits, signatures within so many."""

    def prepare(t):
        fps, node = t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy()

        def edges(s, e):
            x, v = fps[s:e], node[s:e]
            if (v == v[0]).all():
                return None
            sig = None
            if sig_bits is not None:
                sig = np.frombuffer(b"".join(t.column("sig").slice(s, e - s).to_pylist()), np.uint64).reshape(e - s, -1)
            labels = np.arange(e - s)
            for r in range(0, e - s, 256):
                near = np.bitwise_count(x[r : r + 256, None] ^ x[None, r:]) <= radius
                p, q = np.nonzero(near)
                p, q = p + r, q + r
                keep = p < q
                p, q = p[keep], q[keep]
                if sig is not None and len(p):
                    apart = labels[p] != labels[q]
                    p, q = p[apart], q[apart]
                    close = np.concatenate([np.bitwise_count(sig[p[i : i + 65536]] ^ sig[q[i : i + 65536]]).sum(axis=1) <= sig_bits for i in range(0, len(p), 65536)] or [np.zeros(0, bool)])
                    p, q = p[close], q[close]
                forest(labels, p, q)
            other = labels != np.arange(e - s)
            return np.stack([v[other], v[labels[other]]])

        return edges

    return prepare


def candidates(classes: DataFrame, sig_bits: int, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) that join the same nodes as all pairs of classes (node, sig, bands) that share a band and whose sigs differ in at most sig_bits."""

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [np.frombuffer(x, np.int64) for x in batch.column("bands").to_pylist()]
            at = np.repeat(np.arange(len(kept)), [len(x) for x in kept])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(kept or [at])), batch.column("sig").take(pa.array(at)), batch.column("node").take(pa.array(at))], names=["value", "sig", "node"]
            )

    rows = classes.select("node", "sig", "bands").mapInArrow(deal, "value long, sig binary, node long")
    cut = _chunked(rows, ["value"], F.xxhash64("node", F.lit(7)), chunk, scratch)
    return cut.mapInArrow(_by_group(["value", "i", "j"], _signed(sig_bits)), "a long, b long").distinct()


def _signed(sig_bits: int):
    """Edges of a bucket's forest: signatures within sig_bits."""

    def prepare(t):
        node, drawn = t.column("node").to_numpy(), t.column("sig")

        def edges(s, e):
            n, v = e - s, node[s:e]
            sig = np.frombuffer(b"".join(drawn.slice(s, n).to_pylist()), np.uint64).reshape(n, -1)
            labels = np.arange(n)
            for r in range(0, n, 256):
                p, q = np.nonzero(labels[r : r + 256, None] != labels[None, r:])
                p, q = p + r, q + r
                p, q = p[p < q], q[p < q]
                for i in range(0, len(p), 65536):
                    a, b = p[i : i + 65536], q[i : i + 65536]
                    apart = labels[a] != labels[b]
                    a, b = a[apart], b[apart]
                    close = np.bitwise_count(sig[a] ^ sig[b]).sum(axis=1) <= sig_bits
                    forest(labels, a[close], b[close])
            other = labels != np.arange(n)
            return np.stack([v[other], v[labels[other]]])

        return edges

    return prepare


def _similar(least: float):
    """Edges of a group's forest: sets of a similarity of least or more, compared where sketches don't rule it out. Pairs joined already, as all that are close, aren't compared."""

    def prepare(t):
        node, drawn, kept = t.column("node").to_numpy(), t.column("sketch"), t.column("hashes")
        close = t.column("close").to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0, bool)

        def edges(s, e):
            n, v = e - s, node[s:e]
            x = np.frombuffer(b"".join(drawn.slice(s, n).to_pylist()), np.uint8).reshape(n, BINS)
            sets = [np.frombuffer(b, np.uint64) for b in kept.slice(s, n).to_pylist()]
            labels, known = np.arange(n), np.flatnonzero(close[s:e])
            if len(known):
                labels[known] = known[0]
            for r in range(n):
                q = np.flatnonzero(labels[r + 1 :] != labels[r]) + r + 1
                for i in range(0, len(q), 1024):
                    part = q[i : i + 1024]
                    for k in part[similarity(x[r][None], x[part]) >= least - DOUBT].tolist():
                        if labels[k] != labels[r] and jaccard(sets[r], sets[k]) >= least:
                            forest(labels, np.array([r]), np.array([k]))
            other = labels != np.arange(n)
            return np.stack([v[other], v[labels[other]]])

        return edges

    return prepare


def groups(rows: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(fp, component): every fingerprint of rows (doc_id, fp, sig) with the smallest doc_id reachable.

    Equal rows meet first, as one class under their smallest id. Rows without an id are not members of
    a class; a fingerprint that they alone have has a null component.
    """
    classes = scratch.keep(rows.groupBy("fp", "sig").agg(F.min("doc_id").alias("node")))
    joined = components(links(classes.where("node IS NOT NULL"), radius, scratch), scratch)
    return scratch.keep(classes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component")))


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs: 64-bit fingerprints of 3-word shingles.

    A fingerprint bit is 1 if over half of the hashes of the text's shingles (repeats included) set it.
    Rows link at radius or fewer differing bits; component_id is the smallest doc_id reachable. A null or
    empty text, or one of white space, has fingerprint 0 and links like any other. A null doc_id links
    with nothing and has a null component. Repeated rows stay and share a component. No rows: no rows.
    Only doc_id and text are read. Texts are hashed once, where they are read, and only fingerprints
    are shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(_fingerprinted(docs, 3))
    found = groups(rows, radius, scratch).withColumnRenamed("component", "component_id")
    return rows.join(found, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


#: Near copies among documents: five-word shingles of a Jaccard similarity of 0.8 or more.
SIMILARITY = 0.8
#: Bits of the 128 of a candidate's signature that may differ. Of sets of similarity 0.8 about 19 do, with a deviation of 4.1 (24 and 4.4
#: for four shingles of five); of unrelated texts 64, with one of 5.7.
SIG_BITS = 44
#: Bits of the 64 of a fingerprint that may differ for a pair to be found by probes. Of sets of similarity 0.8 about 10 do, of 0.9 about 7;
#: pairs that differ in more are left to the bands of least hashes.
PROBE_RADIUS = 8


def keep_one(docs: DataFrame, sig_bits: int = SIG_BITS, least: float = SIMILARITY, radius: int = PROBE_RADIUS) -> DataFrame:
    """docs without near copies: of each group the row with the smallest doc_id stays, with all its columns.

    Documents of equal sets of five-word shingles are one class and enter once, under their smallest id. All else
    is computed from the sets too, so that neither repeats nor the place of a difference count. Candidates have
    fingerprints that differ in at most radius bits, found by the probes of links() as in near_duplicates(), or, as those of similar
    sets may differ in more, share one of BANDS bands of least hashes; either way they differ in at most sig_bits of a 128-bit
    signature. What they reach is a loose group. Sets of under LEAST_SET shingles have no candidates. Within each group, documents link if their sets have a similarity of least or more (the verification; only
    pairs whose sketches estimate less by over DOUBT are ruled out), and a group is what links reach. All members are
    compared with the smallest id of their loose group first; where some don't link with it, those are compared with all the others. Of rows with the smallest id of a group one stays, as all are
    one document. Rows without an id stay. Rows with a text of no word are one group.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(_profiled(docs).where("doc_id IS NOT NULL"))
    classes = scratch.keep(rows.groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("fp", "sig", "bands")]))
    probed = links(classes.where("length(bands) > 0"), radius, scratch, sig_bits)
    loose = scratch.keep(components(probed.union(candidates(classes, sig_bits, scratch)), scratch))
    of = loose.select(F.col("node").alias("doc_id"))
    drawn = _drawn(docs.join(of, "doc_id", "left_semi")).dropDuplicates(["node", "digest"]).join(classes.select("node", "digest"), ["node", "digest"], "left_semi")
    members = scratch.keep(drawn.join(loose, "node").select("component", "node", "sketch", "hashes"))
    heads = members.where("node = component").select("component", F.col("sketch").alias("_sketch"), F.col("hashes").alias("_hashes"))
    met = members.join(heads, "component").mapInArrow(_by_head(least), "component long, node long, sketch binary, hashes binary, close boolean")
    met = scratch.keep(met)
    cut = _open_groups(met, SKETCHES, SET_BYTES, scratch)
    near = cut.mapInArrow(_by_group(["component", "i", "j"], _similar(least)), "a long, b long")
    near = near.union(met.where("close AND node <> component").select("node", "component"))
    dropped = components(near, scratch).where("node <> component").select("node")
    kept = classes.select("node").join(dropped, "node", "left_anti").select(F.col("node").alias("_id"))
    named = docs.join(kept, docs["doc_id"] == kept["_id"], "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
