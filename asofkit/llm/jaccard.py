"""N-gram Jaccard join by universe partitioning, one-deletion neighbourhoods and exact checks."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, drop_shuffles, fresh, materialise, release, table
from .components import components
from .words import Shingles, first_of_runs, mix, shingle, slices, split_words

#: Classes, and bytes of text, that a checking task holds on each of its two sides at most.
BLOCK_CLASSES, BLOCK_BYTES = 1500, 8_000_000
#: Bits of the filter that keeps texts without candidates from being shuffled.
FILTER_BITS = 1 << 25
#: Bytes of signatures shuffled at a time, against the bytes of the texts.
SIGNATURE_SHARE = 1.5
#: Classes of one signature, and bytes of sketches, that a filtering task holds, about.
LIST_CLASSES, LIST_BYTES = 2000, 16_000_000


@dataclass
class Scheme:
    """How sets of one size band, and of the band below it, are partitioned.

    The sets of a linked pair with sizes r and s differ in at most (r + s)(1 - t)/(1 + t)
    shingles, ``differ`` for the band's largest. Shingles fall by hash into ``segments``, of which
    the first ``wide`` count twice as they are matched up to one deletion, the others once as they
    are matched exactly. These weights sum to differ + 1 + spare + hot, so a linked pair agrees in
    segments of a weight of spare + hot + 1 at least. Hence each set's first ``spare`` empty
    segments need not be indexed, nor need the ``hot`` of its other narrow ones whose lists are the
    longest: with one order for all sets, the last of the segments that a pair agrees in stays for both.
    """

    low: int
    high: int
    differ: int
    segments: int = 1
    wide: int = 0
    spare: int = 0
    hot: int = 0


def bands(largest: int, percent: int) -> list[Scheme]:
    """Size bands from 1 to ``largest``: linked sets are in one band or in neighbouring ones."""
    out, low = [], 1
    while not out or low <= largest:
        high = low * 100 // percent
        out.append(Scheme(low, high, 2 * high * (100 - percent) // (100 + percent)))
        low = high + 1
    last = out[-1].high * 100 // percent
    out.append(Scheme(low, last, 2 * last * (100 - percent) // (100 + percent)))
    return out


def allocate(schemes: list[Scheme], classes: list[int]) -> None:
    """Choose each band's segments, wide ones and spare weight by expected cost.

    ``classes`` counts the sets of every band in the whole corpus. The cost is the signatures
    indexed plus the pairs of unrelated sets that would meet in empty segments. A sixteenth of the
    segments is free to be left out where the counted lists turn out to be long.
    """
    for b, s in enumerate(schemes):
        s.hot = -(-s.differ // 16) if s.differ >= 4 else 0
        n = classes[b] + (classes[b - 1] if b else 0)
        size = (s.low + s.high) / 2
        best = None
        for spare in range(0, 25 if s.differ else 1):
            for wide in range(0, min(3, s.differ) + 1):
                m = s.differ + 1 + s.hot + spare - wide
                if m < max(wide, 1):
                    continue
                empty = math.exp(-size / m)
                expected = (m - wide) * empty
                over = max(0.0, 1 - sum(math.exp(-expected) * expected**i / math.factorial(i) for i in range(spare + 1)))
                cost = n * ((m - wide) * (1 - empty) + wide * (1 + size / m)) + (n * over) ** 2 / 2 * expected
                if best is None or cost < best[0]:
                    best = (cost, m, wide, spare)
        s.segments, s.wide, s.spare = best[1:]


def signatures(sets: Shingles, schemes: list[Scheme], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept texts and their signatures: subset hashes by segment, and deletions in wide ones.

    The lowest bit of a signature is that of its scheme's number, the next is set for narrow segments.
    """
    highs = np.array([s.high for s in schemes])
    counts = sets.counts
    band = np.searchsorted(highs, counts)
    use = keep[sets.doc]
    doc, h = sets.doc[use], sets.hash[use]
    value = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    docs, sigs = [], []
    for up in (0, 1):
        scheme = np.minimum(band + up, len(schemes) - 1)
        m = np.array([s.segments for s in schemes])[scheme]
        wide = np.array([s.wide for s in schemes])[scheme]
        spare = np.array([s.spare for s in schemes])[scheme]
        m = np.where(keep & (counts > 0), m, 0)
        base = np.cumsum(m) - m
        slot = base[doc] + (h % np.maximum(m, 1)[doc].astype(np.uint64)).astype(np.int64)
        total = int(m.sum())
        sums, size = np.zeros(total, np.uint64), np.bincount(slot, minlength=total)
        np.add.at(sums, slot, value)
        owner = np.repeat(np.arange(len(m)), m)
        segment = np.arange(total) - base[owner]
        salt = mix((scheme[owner].astype(np.uint64) << np.uint64(40)) + segment.astype(np.uint64) + np.uint64(1))
        narrow = segment >= wide[owner]
        empty = narrow & (size == 0)
        before = np.cumsum(empty)
        nth = before - np.r_[0, before][base[owner]]  # of the set's empty segments
        emit = ~empty | (nth > spare[owner])
        marks = (scheme & 1).astype(np.uint64)[owner] | narrow.astype(np.uint64) << np.uint64(1)
        clear = ~np.uint64(3)
        docs.append(owner[emit])
        sigs.append(mix(sums[emit] ^ salt[emit]) & clear | marks[emit])
        deleted = ~narrow[slot]
        docs.append(doc[deleted])
        sigs.append(mix((sums[slot] - value)[deleted] ^ salt[slot][deleted]) & clear | marks[slot][deleted])
    return np.concatenate(docs), np.concatenate(sigs).view(np.int64)


def sketches(sets: Shingles) -> list[bytes]:
    """For each set the parities of its shingles' counts in as many hash cells as it has shingles, about.

    The cells are a power of two, at least 64; folding halves makes the sketch of fewer cells. Two
    sets differ in at least as many shingles as their sketches of the same cells differ in bits.
    """
    n = sets.counts
    cells = 64 << np.maximum(np.ceil(np.log2(np.maximum(n, 1) * 0.75 / 64)), 0).astype(np.int64)
    base = np.cumsum(cells) - cells
    at = base[sets.doc] + (mix(sets.hash ^ np.uint64(0x1B873593CC9E2D51)) & (cells - 1)[sets.doc].astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=int(cells.sum())) & 1).astype(np.uint8))
    return [bits[a : a + c].tobytes() if k else b"" for a, c, k in zip((base // 8).tolist(), (cells // 8).tolist(), n.tolist())]


def may_link(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges a, b that connect those classes of each list (sig) that their sketches don't tell apart.

    Every class is compared with all those of its list that aren't connected to it by then.
    """
    out_a, out_b = [], []
    pdf = pdf.drop_duplicates(["sig", "cid"]).sort_values("sig", kind="stable")
    sig, cid, n, sketch = pdf["sig"].to_numpy(), pdf["cid"].to_numpy(), pdf["n"].to_numpy(), pdf["sketch"].tolist()
    starts = np.flatnonzero(first_of_runs(sig))
    for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(sig)]):
        size = min(len(x) for x in sketch[at:end])
        bits = np.empty((end - at, size // 8), np.uint64)
        for i, x in enumerate(sketch[at:end]):
            bits[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size // 8), axis=0)
        ids, count = cid[at:end], n[at:end]
        left = np.arange(1, end - at)
        queue = [0]
        while len(left):
            if queue:
                i = queue.pop()
            else:
                i, left = int(left[0]), left[1:]
            apart = np.bitwise_count(bits[left] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = (apart * (100 + percent) <= (count[left] + count[i]) * (100 - percent)) & (100 * np.minimum(count[left], count[i]) >= percent * np.maximum(count[left], count[i]))
            found = left[near]
            left = left[~near]
            out_a.append(np.full(len(found), ids[i]))
            out_b.append(ids[found])
            queue.extend(found.tolist())
    none = np.empty(0, np.int64)
    return pd.DataFrame({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})


def keys_of(texts: pa.Array) -> list[bytes]:
    """A 128-bit digest of each text's word sequence; texts of one sequence are one class."""
    values, offsets = split_words(texts)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values), " ")
    return [hashlib.blake2b(t.as_buffer() if t.is_valid else b"", digest_size=16).digest() for t in joined]


def class_number(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def profile(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, the class's key and its short number, the text's bytes and its sketch, for every row."""

    def work(batches):
        for batch in batches:
            for b in slices(batch, 1):
                sets = shingle(b.column(1), width)
                keys = keys_of(b.column(1))
                size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), b.column(2), pa.array(sets.counts, pa.int64()), pa.array(keys, pa.binary()), pa.array([class_number(k) for k in keys], pa.int64()), size,
                        pa.array(sketches(sets), pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "key", "cid", "bytes", "sketch"],
                )
        release()

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return hashed.mapInArrow(work, "doc_id long, text_hash long, n_shingles long, key binary, cid long, bytes long, sketch binary")


def indexed(docs: DataFrame, width: int, schemes: list[Scheme], turn: int = 0, turns: int = 1) -> DataFrame:
    """sig, cid: the signatures of each class that have their turn, once for every partition that has it."""

    def work(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for b in slices(batch, 1, rows=400, size=1_500_000):
                sets, keys = shingle(b.column(1), width), keys_of(b.column(1))
                keep = np.zeros(len(keys), bool)
                for i, k in enumerate(keys):
                    if k not in seen:
                        seen.add(k)
                        keep[i] = True
                doc, sig = signatures(sets, schemes, keep)
                if turns > 1:
                    now = sig.view(np.uint64) % np.uint64(turns) == turn
                    doc, sig = doc[now], sig[now]
                cid = np.array([class_number(k) for k in keys], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(cid[doc])], names=["sig", "cid"])
        release()

    return docs.mapInArrow(work, "sig long, cid long")


def bitmap(numbers: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with two set for each class number in the column cid.

    Its size is fixed, so it can be sent to every task: one that is not in it is surely not among
    the numbers. With far more numbers than bits it lets all pass, which costs time only.
    """
    at = [F.col("cid").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("cid", 32).bitwiseAND(FILTER_BITS - 1)]
    bits = numbers.select(F.explode(F.array(*at)).alias("p"))
    one = F.expr("shiftleft(1L, CAST(p & 31L AS INT))")
    words = bits.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(one).alias("v")).toPandas()  # at most FILTER_BITS / 32 rows
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).astype(np.uint32)
    return out


def contains(bits: np.ndarray, cid: np.ndarray) -> np.ndarray:
    out = np.ones(len(cid), bool)
    for p in (cid & (FILTER_BITS - 1), (cid.view(np.uint64) >> np.uint64(32)).astype(np.int64) & (FILTER_BITS - 1)):
        out &= (bits[p >> 5] >> (p & 31).astype(np.uint32) & 1).astype(bool)
    return out


def texts_of(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """key and compressed text of each class whose number the bitmap may hold, once for every partition that has it."""

    def work(batches):
        seen: set[bytes] = set()
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for b in slices(batch, 1):
                keys = keys_of(b.column(1))
                may = contains(wanted, np.array([class_number(k) for k in keys], np.int64)).tolist()
                keep = []
                for k, m in zip(keys, may):
                    keep.append(m and k not in seen)
                    if m:
                        seen.add(k)
                mask = pa.array(keep, pa.bool_())
                packed = [packer.compress((t or "").encode()) for t in b.column(1).filter(mask).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).filter(mask), pa.array(packed, pa.binary())], names=["key", "text"])
        release()

    return docs.mapInArrow(work, "key binary, text binary")


def overlaps(sets: Shingles, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many shingles each of some texts (rows) shares with each of some (columns), exactly."""
    order = np.argsort(sets.id, kind="stable")
    ids, doc = sets.id[order], sets.doc[order]
    first = np.flatnonzero(first_of_runs(ids))
    df = np.diff(np.r_[first, len(ids)])
    each = np.repeat(df, df)
    row, column = np.full(sets.n_texts, -1), np.full(sets.n_texts, -1)
    row[rows], column[columns] = np.arange(len(rows)), np.arange(len(columns))
    out = np.zeros((len(rows), len(columns)), np.float32)
    few = each <= 16
    i, d = ids[few], doc[few]
    for step in range(1, 16):
        same = np.flatnonzero(i[step:] == i[:-step]) if len(i) > step else np.empty(0, np.int64)
        if not len(same):
            break
        for x, y in ((d[same], d[same + step]), (d[same + step], d[same])):
            ok = (row[x] >= 0) & (column[y] >= 0)
            out += np.bincount(row[x[ok]] * len(columns) + column[y[ok]], minlength=out.size).reshape(out.shape).astype(np.float32)
    many = ~few
    i, d = ids[many], doc[many]
    place = np.cumsum(first_of_runs(i)) - 1 if len(i) else i
    width = 1024
    for c in range(0, int(place.max(initial=-1)) + 1, width):
        part = (place >= c) & (place < c + width)
        x = np.zeros((sets.n_texts, width), np.float32)
        x[d[part], place[part] - c] = 1
        out += x[rows] @ x[columns].T
    return out


def check(pdf: pd.DataFrame, width: int, percent: int) -> pd.DataFrame:
    """key, root and links of the classes of one task that are linked in it."""
    pdf = pdf.drop_duplicates(["key", "side"]).reset_index(drop=True)
    unpack = zstandard.ZstdDecompressor()
    sets = shingle(pa.array([unpack.decompress(t).decode() for t in pdf["text"]], pa.string()), width, hashes=False)
    side = pdf["side"].to_numpy()
    rows, columns = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    n = sets.counts.astype(np.float32)
    both = overlaps(sets, rows, columns)
    linked = 100 * both >= percent * (n[rows][:, None] + n[columns][None, :] - both)
    linked &= (n[rows] > 0)[:, None] & (n[columns] > 0)[None, :]
    linked &= rows[:, None] != columns[None, :]
    weight = pdf["members"].to_numpy().astype(np.float64)
    links = np.zeros(len(pdf))
    links[rows] = linked @ weight[columns]
    links[columns] = linked.T @ weight[rows]
    a, b = np.nonzero(linked)
    a, b = rows[a], columns[b]
    root = np.arange(len(pdf))
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    some = links > 0
    release()
    keys = pdf["key"].to_numpy()
    return pd.DataFrame({"key": keys[some], "root": keys[root[some]], "links": links[some].astype(np.int64)})


def candidates(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges a, b between class numbers, whose components hold every linked pair of classes.

    Signatures lead to lists of classes. Each class leaves its longest lists, as many as its scheme
    may spare; equal lists are compared once; and in a list only those classes become connected that
    their sketches don't tell apart. Long lists are cut into blocks, and each task gets two.
    """
    spark = docs.sparkSession
    largest = classes.agg(F.max("n")).first()[0] or 0
    schemes = bands(largest, percent)
    band = band_of(schemes)
    # One row a band; their number grows with the logarithm of the longest text.
    found = {r["band"]: r["count"] for r in classes.groupBy(band(F.col("n")).alias("band")).count().collect()}
    allocate(schemes, [found.get(b, 0) for b in range(len(schemes))])
    # Signatures far larger than the texts, as of very short ones, are shuffled in turns, so that
    # at no time they take more room than SIGNATURE_SHARE of the texts.
    pairs = zip(schemes, schemes[1:])
    expected = 16 * sum(found.get(b, 0) * sum(s.segments + s.wide * s.high / s.segments for s in two) for b, two in enumerate(pairs))
    text_bytes = classes.agg(F.sum("bytes")).first()[0] or 1
    turns = max(1, math.ceil(expected / (SIGNATURE_SHARE * text_bytes)))
    # A running minimum and the row before hold no list; a class in several partitions counts once.
    in_list = Window.partitionBy("sig").orderBy("cid")
    running = in_list.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = []
    for turn in range(turns):
        sigs = indexed(docs, width, schemes, turn, turns).select("sig", "cid", F.min("cid").over(running).alias("first"), F.lag("cid").over(in_list).alias("before"))
        shared.append(materialise(sigs.where("first <> cid and before <> cid").select("sig", "first", "cid"), "join-shared"))
        del sigs
        drop_shuffles(spark)
    lists = reduce(DataFrame.unionByName, shared)
    length = lists.groupBy("sig").agg((F.count("*") + 1).alias("g"), F.first("first").alias("first"))
    members = lists.select("sig", "cid").unionByName(length.select("sig", F.col("first").alias("cid"))).join(length.select("sig", "g"), "sig")
    hots = F.array(*[F.lit(s.hot) for s in [*schemes, schemes[-1]]])
    spared = F.get(hots, F.col("band") + F.when(F.col("band") % 2 == F.col("sig").bitwiseAND(1), 0).otherwise(1))
    longest = Window.partitionBy("cid", "scheme").orderBy(F.desc("narrow"), F.desc("g"), "sig")
    members = members.join(classes.select("cid", band(F.col("n")).alias("band")), "cid").select(
        "sig", "cid", F.col("sig").bitwiseAND(2).alias("narrow"), F.col("sig").bitwiseAND(1).alias("scheme"), "g", spared.alias("spared")
    )
    members = materialise(members.withColumn("place", F.row_number().over(longest)).where("narrow = 0 or place > spared").select("sig", "cid"), "join-members")
    lists = members.groupBy("sig").agg(F.count("*").alias("g"), F.min("cid").alias("first"), F.bit_xor(F.xxhash64("cid")).alias("all")).where("g > 1")
    lists = lists.groupBy("g", "first", "all").agg(F.min("sig").alias("sig")).select("sig", "g")
    dealt = materialise(members.join(lists, "sig").join(classes.select("cid", "n", "sketch"), "cid").select("sig", "g", "cid", "n", "sketch"), "join-lists")
    for x in (*shared, members):
        discard(x)
    short = F.col("g") <= LIST_CLASSES
    size = dealt.where(short).agg(F.count("*"), F.sum(F.length("sketch"))).first()
    buckets = max(1, math.ceil(size[0] / (8 * LIST_CLASSES)), math.ceil((size[1] or 0) / LIST_BYTES))
    blocks = F.ceil(F.col("g") / LIST_CLASSES).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    name = lambda *parts: F.concat_ws("/", *[p.cast("string") for p in parts])
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.when(o != own, name(F.col("sig"), F.least(own, o), F.greatest(own, o))))
    tasks = F.when(short, F.array(F.pmod(F.xxhash64("sig"), F.lit(buckets)).cast("string"))).otherwise(F.filter(others, lambda t: t.isNotNull()))
    edges = dealt.select("sig", "cid", "n", "sketch", F.explode(tasks).alias("task")).groupBy("task").applyInPandas(lambda pdf: may_link(pdf, percent), "a long, b long")
    edges = materialise(edges.distinct(), "join-edges")
    discard(dealt)
    return edges


def band_of(schemes: list[Scheme]):
    bound = [s.high for s in schemes]
    return lambda n: F.size(F.filter(F.array(*[F.lit(h) for h in bound]), lambda h: h < n))


def similar(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Every document with its links and its component under Jaccard similarity of word shingles.

    Words are runs without ASCII white space, A-Z in lower case; a document's set has its distinct
    shingles of ``width`` words, or with fewer words the whole sequence. Two documents link when
    100 * intersection >= percent * union. Null, empty and blank texts have empty sets and no links.

    Texts of one word sequence are a class and are indexed once. Classes that share a signature
    and that their sketches don't tell apart are candidates; in each connected group of these all
    classes are compared by their whole texts, exactly. Large groups are cut into blocks by size
    band, and each task compares two blocks, so no task holds more than BLOCK_CLASSES classes or
    BLOCK_BYTES bytes of each side (a single longer text excepted). A copy costs no comparison.

    Returns doc_id, n_shingles, component_id (the smallest id in the component), n_links (other
    documents linked to) and text_hash (xxhash64 of the text), one row for each given. A null id is
    never the smallest; a component of such rows alone has null. Repeated rows link to each other;
    extra columns are ignored; very long texts are compared whole; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(profile(docs, width), "join-profile")
    full = rows.where(F.col("n_shingles") > 0)
    one = [F.first(c).alias(a) for c, a in (("cid", "cid"), ("n_shingles", "n"), ("bytes", "bytes"), ("sketch", "sketch"))]
    classes = materialise(full.groupBy("key").agg(*one, F.min("doc_id").alias("least"), F.count("*").alias("members")), "join-classes")
    largest = classes.agg(F.max("n")).first()[0] or 0
    band = band_of(bands(largest, percent))
    edges = candidates(docs, classes, width, percent)
    groups = components(edges)
    discard(edges)
    placed = materialise(classes.join(groups.withColumnRenamed("node", "cid"), "cid").select("key", "cid", "n", "bytes", "members", "root", band(F.col("n")).alias("band")), "join-groups")
    sizes = placed.groupBy("root", "band").agg(F.count("*").alias("c"), F.sum("bytes").alias("b"))
    whole = Window.partitionBy("root")
    sizes = sizes.select(
        "root", "band", F.sum("c").over(whole).alias("all"), F.sum("b").over(whole).alias("all_bytes"),
        F.greatest(F.ceil(F.col("c") / BLOCK_CLASSES), F.ceil(F.col("b") / BLOCK_BYTES)).cast("int").alias("blocks"),
    )
    by_band = Window.partitionBy("root").orderBy("band")
    near = lambda f, d: F.coalesce(F.when(f("band", 1).over(by_band) == F.col("band") + d, f("blocks", 1).over(by_band)), F.lit(0))
    sizes = sizes.select("*", near(F.lead, 1).alias("above"), near(F.lag, -1).alias("below"))
    small = (F.col("all") <= BLOCK_CLASSES // 4) & (F.col("all_bytes") <= BLOCK_BYTES // 4)
    sums = sizes.where(small).select("root", "all", "all_bytes").distinct().agg(F.sum("all"), F.sum("all_bytes")).first()
    buckets = max(1, math.ceil((sums[0] or 0) / (BLOCK_CLASSES // 4)), math.ceil((sums[1] or 0) / (BLOCK_BYTES // 4)))
    tasked = placed.join(sizes, ["root", "band"])
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")

    def task(*parts: Column) -> Column:
        return F.concat_ws("/", F.col("root").cast("string"), *[p.cast("string") for p in parts])

    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    pair = lambda t, side: F.struct(t.alias("task"), side.alias("side"))
    own, b = F.col("block"), F.col("band")
    same = F.transform(
        upto(F.col("blocks")),
        lambda o: pair(task(b, F.least(own, o), b, F.greatest(own, o)), F.when(own == o, 2).when(own < o, 0).otherwise(1)),
    )
    above = F.transform(upto(F.col("above")), lambda o: pair(task(b, own, b + 1, o), F.lit(0)))
    below = F.transform(upto(F.col("below")), lambda o: pair(task(b - 1, o, b, own), F.lit(1)))
    bucket = F.array(pair(F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(buckets)).cast("string")), F.lit(2)))
    dealt = tasked.withColumn("block", block).select("key", "members", F.when(small, bucket).otherwise(F.concat(same, above, below)).alias("tasks"))
    compared = (
        dealt.join(texts_of(docs, bitmap(placed)), "key").select("key", "members", "text", F.explode("tasks").alias("t"))
        .select("key", "members", "text", "t.task", "t.side").groupBy("task")
        .applyInPandas(lambda pdf: check(pdf, width, percent), "key binary, root binary, links long")
    )
    linked = materialise(compared, "join-linked")
    tops = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("key").agg(F.sum("links").alias("links"))
    joined = classes.join(tops.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left").withColumn("root", F.coalesce("root", "key"))
    joined = materialise(joined.select("key", "least", "members", "root", F.coalesce("links", F.lit(0)).alias("links")), "join-classes")
    tops = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    # The rows of one root or key may be many; AQE splits such joins, and either side streams.
    named = joined.join(tops, "root").select("key", "component_id", (F.col("members") - 1 + F.col("links")).alias("n_links"))
    return rows.join(named, "key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), "text_hash",
    )


#: All pairs of different word sequences that share a shingle, compared exactly; class by class as in ``similar``.
OP2_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
class AS MATERIALIZED (SELECT row_number() OVER () AS c, w, min(doc_id) AS least, count(*) AS members FROM w WHERE len(w) > 0 GROUP BY w),
each AS MATERIALIZED (SELECT c, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' ')))) AS g FROM class),
size AS MATERIALIZED (SELECT c, count(*) AS n FROM each GROUP BY c),
link AS MATERIALIZED (SELECT x.c AS a, y.c AS b FROM each x JOIN size p ON p.c = x.c JOIN each y ON y.g = x.g AND y.c <> x.c JOIN size q ON q.c = y.c
 WHERE 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n) GROUP BY x.c, y.c HAVING 100 * count(*) >= 90 * (any_value(p.n) + any_value(q.n) - count(*))),
reach AS (SELECT c AS a, c AS b FROM class UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
part AS (SELECT a AS c, min(least) AS component_id FROM reach JOIN class ON class.c = reach.b GROUP BY a),
other AS (SELECT a AS c, sum(members) AS links FROM link JOIN class ON class.c = link.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id, CAST(coalesce(members - 1 + coalesce(links, 0), 0) AS BIGINT) AS n_links
 FROM w LEFT JOIN class USING (w) LEFT JOIN size USING (c) LEFT JOIN part USING (c) LEFT JOIN other USING (c)
"""


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), width=3, percent=90).drop("text_hash")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, of which each component keeps the one of smallest id.

    Documents without words are in no component and stay. Rows without id stay, since nothing
    tells them apart. Of several rows with the smallest id in one component, the one with the
    smallest text stays; rows of one id in different components are judged each in its own.
    """
    found = materialise(similar(docs, width, percent).select("doc_id", "component_id", "text_hash"), "join-kept")
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept"), F.col("text_hash").alias("kept_hash"), "component_id").distinct()
    hashed = F.xxhash64(F.col("text").cast("string"))
    out = docs.join(keep.select("kept", "kept_hash"), (F.col("doc_id").cast("long") == F.col("kept")) & (hashed == F.col("kept_hash")), "left_semi")
    if not found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        place, at = fresh(out, "place"), Window.partitionBy(F.col("doc_id").cast("long")).orderBy("text", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
        out = out.withColumn(place, F.row_number().over(at)).where(F.col(place) == 1).drop(place)
    return out.unionByName(docs.where("doc_id is null"))
