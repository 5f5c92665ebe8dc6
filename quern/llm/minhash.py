"""Near-duplicate documents by HyperMinHash.

A document's shingles are hashed to 64 bits. The hash, as a number from 0 to 1, times ``REGISTERS`` gives the register
(whole part) and its value there (fraction). A register keeps the least value of its shingles in 16 bits: the count of
leading zeros, and the ``MANTISSA`` bits after the first one. Equal minima have equal registers; unlike ones agree by
chance as ``collisions`` computes from both sets' sizes. Registers that no shingle reaches borrow those of others by a
fixed rule, so that small sets have full sketches. Bands of registers are hashed; documents that share a band are
candidates, and the bands' shape keeps the chance to miss a pair at the threshold below ``MISS``. Likeness is estimated
from equal registers with chance collisions taken off, and links are confirmed on full shingle sets.

Documents with equal sets are one class. Within a band, pairs are compared in rounds, so that groups of thousands
need no pair for each two of them: first each document with a few centres of its band, then each outside its band's
main component with its likest document of another one; last, all pairs across components that the estimate
does not rule out (at ``MARGIN`` standard deviations) are confirmed. Pairs within a component need no look, as they
cannot change it. So components are those of all linked pairs that share a band.

Cases: null or empty text, or one without words, has an empty set and no links; texts with fewer words than a shingle
have one shingle, the whole; rows of one doc_id are one node (each row keeps its own set size); null doc_ids have no
links and a null component; repeated rows give repeated results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, dropped, map_arrow, table, written
from .components import components
from .hashing import P, U, hashed_words, mix, stretches, sums

REGISTERS, MANTISSA, PROBES, MISS, MARGIN = 280, 10, 256, 1e-6, 5.0
CENTRES, GROUP = 4, 1000


def shape(percent: int, registers: int = REGISTERS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows a band that miss a pair at the threshold with a chance below ``miss``."""
    j = percent / 100
    return max(((registers // r, r) for r in range(1, 13) if (1 - j**r) ** (registers // r) < miss), key=lambda x: x[1], default=(registers, 1))


def smallest_linked(percent: int) -> int:
    """The smallest set that can be linked with one that differs from it: one that has a single shingle more."""
    return next((n for n in range(1, 200) if 100 * n >= percent * (n + 1)), 200)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles, A-Z in lower case."""
    hashes, before = hashed_words(data, offsets, lower=True)
    prefix = sums(hashes)
    at = np.arange(max(0, len(hashes) - n + 1))
    whole = stretches(prefix, at, at + n)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(whole[a : b - n + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        else:
            out.append(stretches(prefix, np.array([a]), np.array([b])) if b > a else np.zeros(0, U))
    return out


def _probes() -> np.ndarray:
    at = np.arange(REGISTERS * PROBES, dtype=U).reshape(REGISTERS, PROBES)
    return (mix(at * U(P)) % U(REGISTERS)).astype(np.int32)


PROBE = _probes()


def placed(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Register and value there (64 bits) of hashes: the whole part and the fraction of hash / 2**64 * REGISTERS."""
    low = (hashes & U(0xFFFFFFFF)) * U(REGISTERS)
    high = (hashes >> U(32)) * U(REGISTERS) + (low >> U(32))
    return (high >> U(32)).astype(np.int64), (high << U(32)) | (low & U(0xFFFFFFFF))


def pressed(values: np.ndarray) -> np.ndarray:
    """Values in 16 bits: (1 + leading zeros) above the mantissa, which follows the first one bit."""
    # the float's exponent has the place of the first one; cut the value to 53 bits, so that none is rounded up
    size = np.frexp((values >> U(11)).astype(np.float64))[1] + 11
    low = values < U(1 << 11)
    size[low] = np.frexp(values[low].astype(np.float64))[1]
    zeros = np.minimum(64 - size, 62)
    up = np.where(zeros < 62, zeros + 1, 62).astype(U)
    mantissa = (values << up) >> U(64 - MANTISSA)
    return (((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of nonempty sets; 0 never stays."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    if not sets:
        return out
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    # sorted hashes come by register, the least of each first
    register, value = placed(flat)
    first = np.append(True, (row[1:] != row[:-1]) | (register[1:] != register[:-1]))
    out[row[first], register[first]] = pressed(value[first])
    r, c = np.nonzero(out == 0)
    full = out.copy()
    for t in range(PROBES):
        got = out[r, PROBE[c, t]]
        hit = got > 0
        full[r[hit], c[hit]] = got[hit]
        r, c = r[~hit], c[~hit]
        if not len(r):
            break
    for i, j in zip(r.tolist(), c.tolist(), strict=True):  # very small sets: the next register that has one
        filled = np.flatnonzero(out[i])
        full[i, j] = out[i, filled[np.searchsorted(filled, j) % len(filled)]]
    return full


#: Up to here and beyond, the logarithms of shingles a register have a closed form.
_LOAD = np.linspace(-6, 14, 401)


def _met(load: np.ndarray) -> np.ndarray:
    """The sum over leading zeros z of 2**-(z + 1) * (exp(-load * 2**-(z + 1)) - exp(-load * 2**-z)), over the load."""
    out = np.zeros(len(load))
    for z in range(60):
        a = 0.5 ** (z + 1)
        out += a * np.exp(-load * a) * -np.expm1(-load * a)
    return out / load


_MET = _met(np.exp(_LOAD))


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of registers of unlike sets of these sizes that agree by chance in leading zeros and mantissa.

    A register that k shingles reach on average has a least value v with the density k * exp(-k * v) / (1 - exp(-k)),
    and values with z leading zeros fall in cells of width 2**-(z + 1 + MANTISSA); the product of both densities times
    the cell's width, summed over z, is the chance.
    """
    a, b = (np.maximum(np.asarray(x, np.float64), 1) / REGISTERS for x in (n, m))
    return a * b / (np.expm1(-a) * np.expm1(-b)) * np.interp(np.log(a + b), _LOAD, _MET) / (1 << MANTISSA)


def likeness(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Estimated Jaccard index of rows of registers."""
    equal, chance = (a == b).mean(axis=-1), collisions(n, m)
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def _floor(percent: int, n: np.ndarray) -> np.ndarray:
    j = percent / 100
    return j - MARGIN * np.sqrt(j * (1 - j) / np.minimum(REGISTERS, np.maximum(n, 1)))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sketched(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, h1, keys): set size, hash of the set and keys of its bands."""
    bands, rows = shape(percent)
    least = smallest_linked(percent)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*bytes_of(batch.column(1)), n)
        sizes = np.array([len(x) for x in sets], np.int64)
        flat, ends = np.concatenate([*sets, np.zeros(0, U)]), np.append(0, np.cumsum(sizes))
        h1 = stretches(sums(flat), ends[:-1], ends[1:]).view(np.int64)
        able = sizes >= least
        made = sketches([x for x, ok in zip(sets, able, strict=True) if ok])[:, : bands * rows].astype(U)
        keys = stretches(sums(made.ravel()), *(np.arange(made.shape[0] * bands) * rows + k for k in (0, rows)))
        keys = mix(keys ^ mix(np.tile(np.arange(1, bands + 1, dtype=U), made.shape[0]))).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(able * bands)).astype(np.int32)), pa.array(keys))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(h1), lists], names=["doc_id", "n_shingles", "h1", "keys"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, n_shingles bigint, h1 bigint, keys array<bigint>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, size, registers, shingles) with binary columns; the id is that of the set's class."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*bytes_of(batch.column(0)), n)
        made = sketches([x if len(x) else np.zeros(1, U) for x in sets])
        ends = np.append(0, np.cumsum([len(x) for x in sets]))
        ids = stretches(sums(np.concatenate(sets)), ends[:-1], ends[1:]).view(np.int64)
        arrays = [pa.array(ids), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in made], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "size", "registers", "shingles"])

    return map_arrow(docs, run, "id bigint, size bigint, registers binary, shingles binary")


def _candidates(rows: DataFrame, percent: int, mode: str) -> DataFrame:
    """Pairs (a, b, est) within groups of rows (band, part, id, component, lead, size, registers, shingles).

    Rows of the mode ``all`` bring their shingles: only confirmed pairs come out.
    """

    def group(x: pa.Table) -> list[tuple]:
        ids, comp, lead, size = (x.column(c).to_numpy() for c in ("id", "component", "lead", "size"))
        regs = np.frombuffer(b"".join(x.column("registers").to_pylist()), np.uint16).reshape(len(ids), REGISTERS)
        order = np.argsort(ids, kind="stable")
        ids, comp, lead, size, regs = ids[order], comp[order], lead[order], size[order], regs[order]
        shingles = x.column("shingles").take(pa.array(order)) if mode == "all" else None
        full = lambda k: np.frombuffer(shingles[k].as_py(), U)
        seeds = np.arange(min(CENTRES, len(ids))) if mode == "centres" else np.flatnonzero(lead)
        best = np.full(len(ids), -1.0)
        partner = np.zeros(len(ids), np.int64)
        out = []
        for s in seeds.tolist():
            others = np.flatnonzero(comp != comp[s])
            if not len(others):
                continue
            a, b = np.minimum(size[others], size[s]), np.maximum(size[others], size[s])
            others = others[100 * a >= percent * b]
            est = likeness(regs[others], regs[s], size[others], size[s])
            near = est >= _floor(percent, np.maximum(size[others], size[s]))
            others, est = others[near], est[near]
            if mode == "all":
                own = full(s) if len(others) else None
                out += [(ids[s], ids[k], e) for k, e in zip(others.tolist(), est.tolist(), strict=True) if linked(own, full(k), percent)]
            elif mode == "likest" and len(others):
                k = est.argmax()
                out.append((ids[s], ids[others[k]], est[k]))
            else:
                better = est > best[others]
                best[others[better]], partner[others[better]] = est[better], ids[s]
        if mode == "centres":
            out += [(ids[k], partner[k], best[k]) for k in np.flatnonzero(best >= 0)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(whole: pa.Table):
            found: list[tuple] = []
            band, part = whole.column("band").to_numpy(), whole.column("part").to_numpy()
            edges = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (part[1:] != part[:-1])))
            for a, b in zip(edges, np.append(edges[1:], len(band)), strict=True):
                if b - a > 1:
                    found += group(whole.slice(a, b - a))
            a, b, e = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.float64())], names=["a", "b", "est"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 2 * GROUP:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            band, part = whole.column("band").to_numpy(), whole.column("part").to_numpy()
            cut = int(np.flatnonzero((band != band[-1]) | (part != part[-1]))[-1]) + 1 if (band[0], part[0]) != (band[-1], part[-1]) else 0
            if cut:
                yield done(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition("band", "part").sortWithinPartitions("band", "part").mapInArrow(run, "a bigint, b bigint, est double")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are linked."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep.append(linked(np.frombuffer(x, U), np.frombuffer(y, U), percent))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: sets.select(F.col("id").alias(k), F.col("shingles").alias(f"s_{k}"))
    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b"), run, "a bigint, b bigint")


def _rows(bands: DataFrame, labels: DataFrame, sets: DataFrame, mode: str) -> DataFrame:
    """What a round compares: members of bands with several components, in groups of at most 2 * ``GROUP`` rows.

    In the round of centres a large band falls into parts with centres of their own. Later, every document outside
    its band's most frequent component leads, and blocks of leads meet blocks of all members.
    """
    own = bands.join(labels, "id")
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    count = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / GROUP)).cast("int")
    if mode == "centres":
        rows = own.withColumn("lead", F.lit(True)).withColumn("part", block(count("members")))
    else:
        counts = own.groupBy("band", "component").agg(F.count("*").alias("n"))
        main = counts.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max("n").alias("most"))
        main = main.where("kinds > 1").withColumn("leads", F.col("n") - F.col("most"))
        met = own.join(main.select("band", "main", count("leads").alias("i"), count("n").alias("j")), "band")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        leads = met.where("component != main").withColumn("lead", F.lit(True)).withColumn("k", every("j")).withColumn("part", block(F.col("i")) * F.col("j") + F.col("k"))
        members = met.withColumn("lead", F.lit(False)).withColumn("k", every("i")).withColumn("part", F.col("k") * F.col("j") + block(F.col("j")))
        rows = leads.unionByName(members)
    own = sets.select("id", "size", "registers", (F.col("shingles") if mode == "all" else F.lit(None).cast("binary")).alias("shingles"))
    return rows.join(own, "id").select("band", "part", "id", "component", "lead", "size", "registers", "shingles")


def set_ids(docs: DataFrame, n: int, into: str) -> DataFrame:
    """``docs`` with the hash of each text's shingle set in the column ``into``, a name that they must not have."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*bytes_of(batch.column("text")), n)
        ends = np.append(0, np.cumsum([len(x) for x in sets]))
        ids = stretches(sums(np.concatenate([*sets, np.zeros(0, U)])), ends[:-1], ends[1:]).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], names=[*batch.schema.names, into])

    return map_arrow(docs, run, ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema) + f", `{into}` bigint")


def clusters(docs: DataFrame, n: int = 3, percent: int = 85, by_row: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    With ``by_row``, rows of one doc_id are nodes of their own, and each row has the hash of its set (``set_id``) and
    its component's label (null where the set is empty) besides.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = written(_sketched(docs, n, percent), "sketches")
    known = sketched.where("doc_id is not null and n_shingles > 0").withColumnRenamed("h1", "id")
    classes = known.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    exploded = classes.where("size(keys) > 0").select("id", F.explode("keys").alias("band"))
    # many bands have the same members: one of each is enough
    shared = exploded.groupBy("band").agg(F.count("*").alias("members"), F.min("id").alias("least"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sign")).where("members > 1")
    shared = shared.groupBy("members", "least", "sign").agg(F.min("band").alias("band")).select("band", "members")
    bands = written(exploded.join(shared, "band"), "bands")
    ids = bands.select("id").distinct()
    some = docs.join(classes.select("id", "doc_id").join(ids, "id").select("doc_id").distinct().hint("shuffle_hash"), "doc_id")
    sets = written(_sets(some.select("text"), n).join(ids, "id", "left_semi").dropDuplicates(["id"]), "sets")
    # the classes of one doc_id's rows are joined from the start
    member = known.select("doc_id", "id").distinct()
    several = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a < most")
    ties = written(member.join(several, "doc_id").where("id != a").select("a", F.col("id").alias("b")).distinct(), "ties")
    if by_row or ties.isEmpty():
        labels = ids.withColumn("component", F.col("id"))
    else:
        labels = ids.join(components(ties).withColumnRenamed("node", "id"), "id", "full").withColumn("component", F.coalesce("component", "id"))
    labels = written(labels, "labels")
    for mode in ("centres", "likest", "all"):
        pairs = _candidates(_rows(bands, labels, sets, mode), percent, mode)
        if mode != "all":
            pairs = _confirmed(pairs.groupBy("a").agg(F.max_by("b", "est").alias("b")), sets, percent)
        side = lambda k, labels=labels: labels.select(F.col("id").alias(k), F.col("component").alias(f"c_{k}"))
        links = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        links = written(links.where("a != b").distinct(), "round")
        if links.isEmpty():
            continue
        moved = labels.join(components(links).select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
        nxt = written(moved.select("id", F.coalesce("to", "component").alias("component")), "labels")
        dropped(labels)
        labels = nxt
    found = member.join(labels, "id", "left").select("doc_id", *(["id"] if by_row else []), F.coalesce("component", "id").alias("component")).distinct()
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = found.join(least, "component")
    if by_row:
        out = sketched.withColumnRenamed("h1", "id").join(found, ["doc_id", "id"], "left")
    else:
        out = sketched.join(found.select("doc_id", "component_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    own = [F.col("id").alias("set_id"), "component"] if by_row else []
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), *own)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked on 3-word shingles at 0.85."""
    return clusters(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (WITH RECURSIVE r(node, got) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.got) SELECT node, min(got) AS got FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.got AS component_id, w.doc_id = r.got AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.node = w.doc_id
"""
