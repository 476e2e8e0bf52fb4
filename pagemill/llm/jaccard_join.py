"""N-gram Jaccard join: a blocked sparse product of the document by shingle incidence.

1. One pass over the texts hashes every document's distinct shingles. Chunks of documents send each key once, with its
   local count, to the bucket of the key (pre-aggregation: a key that every document holds is one entry a chunk).
2. Buckets sum the counts and send back the keys that two or more sets hold. A document can only have a partner if such
   keys make up the threshold's share of its set; all others leave the join here, and with them nearly all shingles.
3. The rest order their keys from rare to frequent. Two sets that reach the threshold share a key among the first
   |S| - ceil(t |S|) + 1 keys of each (prefix bound), so documents fall into zones that no link leaves.
4. Every zone is compared with a few pivots. What one pivot holds together already needs no product. The rest of a zone
   is cut into blocks of bounded size; pairs of blocks that size bounds and pivots leave open are multiplied, and each
   product emits no more links than join its documents.

Sets that are equal are one class throughout; copies are never expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import bounded_batches, cut, release, table
from pagemill.llm.components import connected

#: Shingles that a chunk gathers before it sends them, documents a chunk holds at most, and keys a bucket gets on average.
CHUNK_SHINGLES, CHUNK_DOCS, BUCKET_KEYS = 500_000, 60_000, 1_000_000
#: Bits of a key; keys are the leading bits of 64-bit shingle hashes.
KEY_BITS = 52
#: Keys and documents that a block of a zone holds, and pivots a zone is compared with.
BLOCK_KEYS, BLOCK_DOCS, PIVOTS = 200_000, 1_000, 4
#: Documents of a key up to which the product adds its pairs one by one; keys of more go through panels of the incidence matrix.
LIGHT = 12
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MANY = 0xFFFF
#: One document of a chunk.
META = np.dtype([("id", "<i8"), ("null", "?"), ("n", "<i8"), ("key", "V16"), ("local", "<i4")])


class WordCodes(dict):
    """64-bit codes of words, kept between texts up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, codes: WordCodes, size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, and no words give none."""
    if text is None:
        return np.empty(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    a = np.fromiter(map(codes.__getitem__, found), np.uint64, len(found))
    if not len(a):
        return a
    width = min(size, len(a))
    h = a[: len(a) - width + 1].copy()
    for k in range(1, width):
        h = _mixed(h) + a[k : len(a) - width + 1 + k]
    return np.unique(_mixed(h + np.uint64(width)))


def _pack(values: np.ndarray) -> bytes:
    """Ascending whole numbers: the first, then differences of as few bytes each as the largest needs, led by that number."""
    steps = np.diff(values, prepend=values[:1]).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    width = data[0]
    wide = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64) + np.frombuffer(data, "<u8", 1, 1)


PARTS = "part long, chunk long, kind int, a binary, b binary, c binary"


def _chunks(n_buckets: int, size: int):
    """The kernel of step 1: entries for buckets (kind 0) and one row for the chunk itself (kind 1)."""

    def send(chunk: int, docs: list[tuple[int, np.ndarray]]) -> Iterator[pd.DataFrame]:
        local: dict[bytes, int] = {}
        sets, rows = [], []
        for doc_id, h in docs:
            key = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else b""
            if len(h) and key not in local:
                local[key] = len(sets)
                sets.append(np.unique(h >> np.uint64(64 - KEY_BITS)))
            rows.append((doc_id, len(h), key, local.get(key, -1)))
        lengths = np.array([len(s) for s in sets], np.int64)
        keys = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), lengths)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.diff(keys, prepend=np.uint64(1 << 63)) != 0) if len(keys) else np.empty(0, np.int64)
        counts = np.diff(first, append=len(keys))
        unique, field = keys[first], np.where(counts > 1, MANY, owner[first]).astype("<u2")
        again = np.repeat(counts > 1, counts)
        out = [(-1 - chunk, chunk, 1, _meta(rows), keys[again].astype("<u8").tobytes(), owner[again].astype("<u2").tobytes())]
        bucket = unique // np.uint64(-(-(1 << KEY_BITS) // n_buckets))
        starts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 63)) != 0) if len(unique) else np.empty(0, np.int64)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(unique)], strict=False):
            many = counts[lo:hi]
            out.append((int(bucket[lo]), chunk, 0, _pack(unique[lo:hi]), field[lo:hi].tobytes(), many[many > 1].astype("<u4").tobytes()))
        yield pd.DataFrame(out, columns=["part", "chunk", "kind", "a", "b", "c"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, codes, docs, held = TaskContext.get().partitionId() << 24, WordCodes(), [], 0
        for batch in batches:
            for doc_id, missing, text in zip(batch["id"], batch["missing"], batch["text"], strict=True):
                docs.append((None if missing else doc_id, h := shingles(text, codes, size)))
                held += len(h)
                if held >= CHUNK_SHINGLES or len(docs) >= CHUNK_DOCS:
                    yield from send(at, docs)
                    at, docs, held = at + 1, [], 0
        if docs:
            yield from send(at, docs)
        del docs, codes
        release()

    return run


def _meta(rows: list[tuple]) -> bytes:
    """Documents of a chunk as fixed records: id, whether it is null, set size, 16 bytes of set key, place among the chunk's sets."""
    out = np.zeros(len(rows), META)
    for i, (doc_id, n, key, local) in enumerate(rows):
        out[i] = (doc_id or 0, doc_id is None, n, key.ljust(16, b"\0"), local)
    return out.tobytes()


def _read_meta(data: bytes) -> np.ndarray:
    return np.frombuffer(data, META)


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 2: counts over all chunks; every chunk gets back its keys that two or more sets hold (kind 2)."""
    if (pdf["kind"] == 1).all():
        return pdf
    keys, fields, source, weights = [], [], [], []
    for i, (a, b, c) in enumerate(zip(pdf["a"], pdf["b"], pdf["c"], strict=True)):
        k, f = _unpack(a), np.frombuffer(b, "<u2")
        w = np.ones(len(k), np.int64)
        w[f == MANY] = np.frombuffer(c, "<u4")
        keys.append(k), fields.append(f), weights.append(w), source.append(np.full(len(k), i, np.int32))
    k, f, w, s = map(np.concatenate, (keys, fields, weights, source))
    order = np.argsort(k, kind="stable")
    k, f, w, s = k[order], f[order], w[order], s[order]
    first = np.flatnonzero(np.diff(k, prepend=np.uint64(1 << 63)) != 0)
    total = np.add.reduceat(w, first) if len(first) else np.empty(0, np.int64)
    df = np.repeat(total, np.diff(first, append=len(k)))
    keep = df > 1
    k, f, s, df = k[keep], f[keep], s[keep], np.minimum(df[keep], (1 << 32) - 1)
    order = np.argsort(s, kind="stable")
    k, f, s, df = k[order], f[order], s[order], df[order]
    ends = np.searchsorted(s, np.arange(len(pdf) + 1))
    chunks, out = pdf["chunk"].to_numpy(), []
    for i in range(len(pdf)):
        lo, hi = ends[i], ends[i + 1]
        if lo < hi:
            out.append((-1 - chunks[i], chunks[i], 2, _pack(k[lo:hi]), f[lo:hi].tobytes(), df[lo:hi].astype("<u4").tobytes()))
    return pd.DataFrame(out, columns=list(pdf.columns))


def _documents(threshold: int):
    """Step 3: the documents of a chunk; those that can have a partner get their shared keys, from rare to frequent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["kind"] == 1].iloc[0]
        meta, many, owner = _read_meta(own["a"]), np.frombuffer(own["b"], "<u8"), np.frombuffer(own["c"], "<u2")
        keys, docs, freq = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b, c in pdf.loc[pdf["kind"] == 2, ["a", "b", "c"]].itertuples(index=False):
            k, f, df = _unpack(a), np.frombuffer(b, "<u2"), np.frombuffer(c, "<u4").astype(np.int64)
            single = f != MANY
            keys.append(k[single]), docs.append(f[single].astype(np.int64)), freq.append(df[single])
            lo, hi = np.searchsorted(many, k[~single], "left"), np.searchsorted(many, k[~single], "right")
            for x, y, z, d in zip(lo, hi, k[~single], df[~single], strict=True):
                keys.append(np.full(y - x, z, np.uint64)), docs.append(owner[x:y].astype(np.int64)), freq.append(np.full(y - x, d, np.int64))
        k, d, f = map(np.concatenate, (keys, docs, freq))
        order = np.lexsort((k, f, d))
        k, d = k[order], d[order]
        n_sets = int(meta["local"].max()) + 1 if len(meta) else 0
        ends = np.searchsorted(d, np.arange(n_sets + 1))
        out, done = [], set()
        for row in meta:
            local, n, shared = int(row["local"]), int(row["n"]), None
            if local >= 0 and local not in done:
                done.add(local)
                mine = k[ends[local] : ends[local + 1]]
                if 100 * len(mine) >= threshold * n:
                    shared = mine.astype(np.int64).tolist()
            out.append((None if row["null"] else int(row["id"]), n, row["key"].tobytes(), shared))
        return pd.DataFrame({"doc_id": pd.array([x[0] for x in out], "Int64"), "n_shingles": [x[1] for x in out], "sid": [x[2] for x in out], "keys": [x[3] for x in out]})

    return run


def linked(n: Column, m: Column, overlap: Column, threshold: int) -> Column:
    return overlap * 100 >= (n + m - overlap) * threshold


def _overlaps(owner: np.ndarray, column: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The product of an incidence matrix of n documents with its transpose, above the diagonal: entries are (owner, column),
    and count holds the documents of each column.

    Columns of few documents add their pairs one by one, so that a sparse block costs what it holds; the others are
    multiplied in dense panels of bounded size. Columns of one document are in no pair.
    """
    order = np.lexsort((owner, column))
    owner, column = owner[order], column[order]
    size, cells = count[column], [np.empty(0, np.int64)]
    for k in range(2, LIGHT + 1):
        rows = owner[size == k].reshape(-1, k)
        for i in range(k - 1):
            cells.append((rows[:, i : i + 1] * n + rows[:, i + 1 :]).ravel())
    overlap = np.bincount(np.concatenate(cells), minlength=n * n).astype(np.int32).reshape(n, n)
    heavy = size > LIGHT
    owner, column = owner[heavy], np.searchsorted(np.flatnonzero(count > LIGHT), column[heavy])
    width, step = int((count > LIGHT).sum()), max(256, 2_000_000 // max(1, n))
    for lo in range(0, width, step):
        x, y = np.searchsorted(column, (lo, lo + step))
        panel = np.zeros((n, min(step, width - lo)), np.float32)
        panel[owner[x:y], column[x:y] - lo] = 1
        overlap += np.triu(panel @ panel.T, 1).astype(np.int32)
    return overlap


def _product(threshold: int):
    """Step 4: links of one task's zones; the shared keys of two documents are counted by sparse products of incidence blocks,
    and pairs below the bound that follows from their sizes are discarded."""

    def links(zone: pd.DataFrame) -> list[tuple[bytes, bytes]]:
        sets, n, side = list(zone["keys"]), zone["n_shingles"].to_numpy(np.int64), zone["side"].to_numpy()
        labels, ids = [x if x is not None else i for i, x in enumerate(zone["label"])], list(zone["sid"])
        code = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        label = np.array([code[x] for x in labels])
        keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        unique, column, count = np.unique(keys, return_inverse=True, return_counts=True)
        shared = _overlaps(owner, column, count, len(sets))
        close = 100 * shared >= threshold * (n[:, None] + n[None, :] - shared)
        close &= label[:, None] != label[None, :]
        if (side != side[0]).any():
            close &= side[:, None] != side[None, :]
        parent = {i: i for i in range(len(code))}

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        out = []
        for i, j in zip(*np.nonzero(np.triu(close, 1)), strict=True):
            a, b = root(label[i]), root(label[j])
            if a != b:
                parent[a] = b
                out.append((ids[i], ids[j]))
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([e for _, zone in pdf.groupby("zone") for e in links(zone)], columns=["src", "dst"])

    return run


def jaccard_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 75, size: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest doc_id that it reaches by links.

    Words are lower-cased from A to Z; a document's set holds its distinct shingles of `size` words, or its whole
    sequence of words if it has fewer. Two documents link when 100 * |A and B| >= threshold * |A or B|, exactly.
    A null or wordless text has an empty set and links with nothing: its component is its own doc_id. Equal sets link.
    Repeated rows, also of one doc_id, count as documents of their own and keep one row each; documents without a
    doc_id take part, and a component of such alone has the component null. Other columns of the input, whatever their
    names, are not read. An empty table gives an empty table. Texts of any length are taken whole.
    """
    given = F.col(f"`{doc_id}`").cast("long")
    source = documents.select(F.coalesce(given, F.lit(0)).alias("id"), given.isNull().alias("missing"), F.col(f"`{text}`").alias("text"))
    bounded_batches(documents.sparkSession)
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8, math.ceil(n_bytes / 6 / BUCKET_KEYS))
    sent = source.mapInPandas(_chunks(n_buckets, size), PARTS)
    shared = sent.groupBy("part").applyInPandas(_bucket, PARTS)
    found = cut(shared.groupBy("chunk").applyInPandas(_documents(threshold), "doc_id long, n_shingles long, sid binary, keys array<long>"))
    classes = cut(found.filter("keys IS NOT NULL").select("sid", "n_shingles", "keys").dropDuplicates(["sid"]))
    whole = F.col("n_shingles").cast("long")
    prefix = F.expr(f"slice(keys, 1, cast(size(keys) - ((n_shingles * {threshold} + 99) div 100) + 1 as int))")
    postings = classes.select("sid", F.explode(prefix).alias("key"))
    heads = postings.groupBy("key").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    candidates = postings.join(heads, "key").filter("sid != head").select(F.col("sid").alias("src"), F.col("head").alias("dst")).distinct()
    zones = connected(candidates)
    members = cut(classes.join(zones.select(F.col("node").alias("sid"), F.col("component").alias("zone")), "sid"))
    chosen = members.groupBy("zone").agg(*(F.min(F.struct(F.xxhash64(F.lit(i), "sid").alias("h"), F.col("sid").alias("p"))).alias(f"p{i}") for i in range(PIVOTS)))
    chosen = chosen.select("zone", F.explode(F.array_distinct(F.array(*(F.col(f"p{i}.p") for i in range(PIVOTS))))).alias("pivot"))
    pivots = chosen.join(members.select(F.col("sid").alias("pivot"), F.col("n_shingles").alias("pn"), F.col("keys").alias("pkeys")), "pivot")
    bounds = (whole * 100 >= F.col("pn") * threshold) & (F.col("pn") * 100 >= whole * threshold)
    near = members.join(pivots, "zone").filter(bounds & (F.col("sid") != F.col("pivot")))
    near = near.filter(linked(whole, F.col("pn"), F.size(F.array_intersect("keys", "pkeys")), threshold)).select("sid", "pivot")
    near = cut(near)
    own = chosen.select(F.col("pivot").alias("sid"), "pivot")
    labels = near.unionByName(own).groupBy("sid").agg(F.min("pivot").alias("label"))
    # A document weighs its keys, and at least so much that a block holds no more than BLOCK_DOCS: short texts share few keys.
    weight = F.greatest(F.size("keys"), F.lit(-(-BLOCK_KEYS // BLOCK_DOCS)))
    labelled = members.select("sid", "zone", "n_shingles", weight.alias("n_keys")).join(labels, "sid", "left")
    sums = labelled.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labelled"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n_keys").alias("zone_keys"))
    open_zones = sums.filter("n > n_labelled OR lo != hi").select("zone", "zone_keys")
    tiered = labelled.join(open_zones, "zone").withColumn("tier", F.when(F.col("zone_keys") <= BLOCK_KEYS, -1).otherwise(F.floor(F.log(whole) / math.log(100 / threshold))).cast("int"))
    tiered = tiered.withColumn("held", F.when(F.col("tier") >= 0, F.col("label")))
    held = F.coalesce("held", F.lit(b""))
    sizes = tiered.groupBy("zone", "tier", held.alias("h")).agg(F.sum("n_keys").alias("block_keys"))
    placed = tiered.withColumn("h", held).join(sizes, ["zone", "tier", "h"])
    placed = cut(placed.withColumn("block", F.pmod(F.xxhash64("sid"), F.greatest(F.lit(1), F.ceil(F.col("block_keys") / BLOCK_KEYS)))).select("sid", "zone", "label", "tier", "h", "block"))
    small_tasks = max(1, math.ceil((placed.filter("tier < 0").count() or 1) / 400))
    small = placed.filter("tier < 0").select("sid", "zone", "label", F.lit(0).alias("side"), F.concat(F.lit("small "), F.pmod(F.xxhash64("zone"), F.lit(small_tasks)).cast("string")).alias("task"))
    blocks = placed.filter("tier >= 0").select("zone", "tier", "h", "block").distinct()
    other = blocks.select("zone", *(F.col(c).alias(f"{c}2") for c in ("tier", "h", "block")))
    me, you = F.struct("tier", "h", "block"), F.struct("tier2", "h2", "block2")
    meets = (F.col("tier2") - F.col("tier")).between(-1, 1) & (me <= you) & ((F.col("h") != F.col("h2")) | (F.col("h") == F.lit(b"")))
    pairs = blocks.join(other, "zone").filter(meets)
    parts = [F.hex(c) if c in ("zone", "h", "h2") else F.col(c).cast("string") for c in ("zone", "tier", "h", "block", "tier2", "h2", "block2")]
    pairs = pairs.withColumn("task", F.sha2(F.concat_ws("|", *parts), 256))
    sides = pairs.select("zone", "tier", "h", "block", "task", F.lit(0).alias("side")).unionByName(
        pairs.filter(me != you).select("zone", F.col("tier2").alias("tier"), F.col("h2").alias("h"), F.col("block2").alias("block"), "task", F.lit(1).alias("side"))
    )
    large = placed.filter("tier >= 0").join(sides, ["zone", "tier", "h", "block"]).select("sid", "zone", "label", "side", "task")
    work = small.unionByName(large).join(members.select("sid", "n_shingles", "keys"), "sid")
    rest = work.groupBy("task").applyInPandas(_product(threshold), "src binary, dst binary")
    edges = near.select(F.col("sid").alias("src"), F.col("pivot").alias("dst")).unionByName(rest)
    joined = connected(edges)
    class_of = found.select("doc_id", "n_shingles", "sid").join(joined.select(F.col("node").alias("sid"), F.col("component")), "sid", "left")
    class_of = class_of.withColumn("component", F.coalesce("component", "sid"))
    # Written first, so that the join back has two plain exchanges and can be split at a very large component.
    least = cut(class_of.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    out = class_of.filter("n_shingles > 0").join(least, "component").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(found.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT rid, doc_id, array_to_string(ws[i:i+least(4, len(ws) - 1)], ' ') AS g
  FROM (SELECT rid, doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
strong AS (
  SELECT rid FROM s JOIN n USING (rid) SEMI JOIN shared USING (g) GROUP BY rid, n HAVING 100 * count(*) >= 75 * n
), r AS (SELECT rid, doc_id, g FROM s SEMI JOIN strong USING (rid)),
links AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM r a JOIN r b ON a.g = b.g AND a.rid <> b.rid JOIN n x ON x.rid = a.rid JOIN n y ON y.rid = b.rid
  GROUP BY a.rid, b.rid, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (SELECT DISTINCT a AS rid, a AS other FROM links UNION SELECT reach.rid, links.b FROM reach JOIN links ON links.a = reach.other),
least_id AS (SELECT reach.rid, min(w.doc_id) AS component_id FROM reach JOIN w ON w.rid = reach.other GROUP BY reach.rid)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (rid) LEFT JOIN least_id l USING (rid)
"""

QUERIES = {"op9_jaccard_join": op9_jaccard_join}
SQL = {"op9_jaccard_join": ORACLE}
