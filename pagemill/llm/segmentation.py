"""SentencePiece encoding and decoding, with Gumbel top-k sampling of segmentations without replacement.

A text is a row of stretches (spaces and what follows up to the next space); no piece of the vocabulary crosses them, so
the lattice of the text is a row of small lattices. A* over regions of segmentations: a region is a fixed start, one
stretch that must differ from what was found there, and a free rest; its priority is the perturbed maximum of its
probability mass, drawn from a Gumbel distribution truncated at its parent's. The best region gives the next
segmentation and falls into smaller regions. Random numbers are hashes of the row key, so a row has the same samples
wherever it is computed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from pagemill.llm.common import bounded_batches, release, table
from pagemill.llm.token_counts import TOKENIZERS

#: Samples for each text, weight of the piece ranks in the sampling, and characters that are sampled together.
SAMPLES, ALPHA, TOGETHER = 2, 1.0, 1_000_000
STRETCH = re.compile(" +[^ ]*|[^ ]+")
#: Characters with a column of their own in the table of the trie; the rest is looked up by search.
DENSE = 128


class Pieces:
    """The vocabulary of a SentencePiece model as a trie of characters, with log probabilities from ranks.

    A piece of rank r has the probability 1 / (r + 2) up to a constant, ranks being those of the model's scores.
    """

    def __init__(self, model: bytes, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [sp.id_to_piece(i) for i in range(len(sp))]
        self.byte_ids = np.zeros(256, np.int64)
        normal = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_ids[int(name[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append((i, name.replace("▁", " ")))
        if any(" " in name.strip(" ") or (name.rstrip(" ") != name and name.strip(" ")) for _, name in normal):
            raise ValueError("a piece of the model holds a space after another character")
        order = sorted(normal, key=lambda x: (-sp.get_score(x[0]), x[0]))
        self.byte_cost = -alpha * math.log(len(order) + 2)
        self.raw = [b""] * len(names)
        for i, name in normal:
            self.raw[i] = name.encode("utf-8")
        for value, i in enumerate(self.byte_ids):
            self.raw[int(i)] = bytes([value])
        self.longest = max(len(name) for _, name in normal)
        nodes: list[dict[str, int]] = [{}]
        piece, cost = [-1], [0.0]
        for rank, (i, name) in enumerate(order):
            at = 0
            for c in name:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({}), piece.append(-1), cost.append(0.0)
                at = nodes[at][c]
            piece[at], cost[at] = i, -alpha * math.log(rank + 2)
        self.piece, self.cost = np.array(piece, np.int32), np.array(cost)
        inner = [n for n, steps in enumerate(nodes) if steps]
        self.row = np.zeros(len(nodes), np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        self.dense = np.zeros((len(inner) + 1, DENSE), np.int32)
        sparse = []
        for n in inner:
            for c, to in nodes[n].items():
                if ord(c) < DENSE:
                    self.dense[self.row[n], ord(c)] = to
                else:
                    sparse.append(((n << 21) | ord(c), to))
        sparse.sort()
        self.sparse_keys = np.array([k for k, _ in sparse], np.int64)
        self.sparse_to = np.array([t for _, t in sparse], np.int32)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        out = self.dense[self.row[node], np.minimum(code, DENSE - 1)]
        wide = np.flatnonzero(code >= DENSE)
        if len(wide):
            keys = (node[wide].astype(np.int64) << 21) | code[wide]
            at = np.searchsorted(self.sparse_keys, keys)
            at[at == len(self.sparse_keys)] = 0
            out[wide] = np.where(self.sparse_keys[at] == keys, self.sparse_to[at], 0) if len(self.sparse_keys) else 0
        return out

    def decode(self, ids) -> str:
        """The text of a row of piece ids; the space that encoding put before the text is taken off."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


class Lattices:
    """The lattices of distinct stretches.

    A node is a place in a stretch; nodes are numbered by the characters left, so what follows a node has a lower number.
    Edges stand by node, long pieces first: piece, log of the share of the node's paths that take it, and the next node.
    """

    def __init__(self, pieces: Pieces, stretches: list[str]):
        lengths = np.array([len(s) for s in stretches], np.int64)
        codes = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        stop = np.cumsum(lengths)
        n = self.end = len(codes)
        end = np.repeat(stop, lengths)
        left = end - np.arange(n)
        order = np.argsort(left, kind="stable")
        number = np.empty(n, np.int32)
        number[order] = np.arange(n, dtype=np.int32)
        self.first = number[stop - lengths]
        degree, found = np.zeros(n, np.int64), []
        who, at, node, room = np.arange(n), order, np.zeros(n, np.int32), left[order]
        for depth in range(pieces.longest):
            node = pieces.step(node, codes[at + depth])
            whole = pieces.piece[node] >= 0
            w, m = who[whole], node[whole]
            piece, cost = pieces.piece[m], pieces.cost[m]
            if not depth:
                alone = np.flatnonzero(~whole)
                c = codes[at[alone]]
                w, piece = np.concatenate((w, alone)), np.concatenate((piece, -2 - c))
                cost = np.concatenate((cost, pieces.byte_cost * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))))
            degree[w] += 1
            found.append((w, piece, cost))
            more = (node > 0) & (room > depth + 1)
            who, at, node, room = who[more], at[more], node[more], room[more]
            if not len(who):
                break
        self.offset = np.concatenate(([0], np.cumsum(degree)))
        self.piece, self.log = np.empty(self.offset[-1], np.int32), np.empty(self.offset[-1])
        self.next = np.empty(self.offset[-1], np.int32)
        free = self.offset[1:].copy()
        for depth, (w, piece, cost) in enumerate(found):
            free[w] -= 1
            to = free[w]
            self.piece[to], self.log[to] = piece, cost
            after = order[w] + depth + 1
            self.next[to] = np.where(after == end[order[w]], n, number[np.minimum(after, n - 1)])
        # The log mass and the number of what can follow each node, from the ends of the stretches to their starts.
        beta, paths = np.zeros(n + 1), np.ones(n + 1)
        sorted_left = left[order]
        marks = np.searchsorted(sorted_left, np.arange(1, (sorted_left[-1] if n else 0) + 2))
        for lo, hi in zip(marks, marks[1:], strict=False):
            if lo == hi:
                continue
            x, y = self.offset[lo], self.offset[hi]
            starts, many = self.offset[lo:hi] - x, degree[lo:hi]
            total = self.log[x:y] + beta[self.next[x:y]]
            top = np.maximum.reduceat(total, starts)
            beta[lo:hi] = top + np.log(np.add.reduceat(np.exp(total - np.repeat(top, many)), starts))
            self.log[x:y] = total - np.repeat(beta[lo:hi], many)
            paths[lo:hi] = np.minimum(np.add.reduceat(paths[self.next[x:y]], starts), 1e290)
        share = np.exp(self.log)
        summed = np.cumsum(share)
        base = summed[self.offset[:-1]] - share[self.offset[:-1]] if n else summed
        self.cumulated = (summed - np.repeat(base, degree)).astype(np.float32)
        self.cumulated[self.offset[1:] - 1] = np.inf
        self.node_paths, self.paths = paths, paths[self.first]

    def sample(self, kinds: np.ndarray, seeds: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each stretch given by its number: numbers of pieces, all pieces in a row, log probabilities."""
        log, counts, steps = np.zeros(len(kinds)), np.zeros(len(kinds), np.int64), []
        live, here = np.arange(len(kinds)), self.first[kinds]
        while len(live):
            u = uniform(seeds[live], turn, len(steps)).astype(np.float32)
            edge = self.offset[here]
            todo = np.flatnonzero(self.cumulated[edge] < u)
            while len(todo):
                edge[todo] += 1
                todo = todo[self.cumulated[edge[todo]] < u[todo]]
            log[live] += self.log[edge]
            counts[live] += 1
            steps.append((live, self.piece[edge]))
            here = self.next[edge]
            more = here < self.end
            live, here = live[more], here[more]
        offset = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int64)
        for depth, (who, piece) in enumerate(steps):
            flat[offset[who] + depth] = piece
        return counts, flat, log

    def other(self, kind: int, found: list[tuple[int, ...]], seed: int, turn: int) -> tuple[list[int], float]:
        """A segmentation of one stretch that is none of those found, and its log probability, drawn exactly.

        From node to node an edge has its share of the paths less that of the found paths which still run through it; an
        edge all of whose paths are found has none, whatever rounding leaves.
        """
        node, out, log, depth = int(self.first[kind]), [], 0.0, 0
        rest = [(f, math.exp(self.log_of(kind, f))) for f in found]
        while node < self.end:
            x, y = int(self.offset[node]), int(self.offset[node + 1])
            pieces, mass = self.piece[x:y].tolist(), np.exp(self.log[x:y])
            through = [0] * len(pieces)
            for path, p in rest:
                mass[pieces.index(path[0])] -= p
                through[pieces.index(path[0])] += 1
            usable = [i for i in range(len(pieces)) if through[i] < self.node_paths[self.next[x + i]]]
            weight = np.maximum(mass[usable], 0.0)
            if not weight.sum() > 0:
                weight[:] = 1.0
            u = float(uniform(np.array([seed], np.uint64), turn, 1000 + depth)[0]) * weight.sum()
            pick = usable[min(int(np.searchsorted(np.cumsum(weight), u, "right")), len(usable) - 1)]
            share = float(self.log[x + pick])
            rest = [(path[1:], q / math.exp(share)) for path, q in rest if path[0] == pieces[pick] and len(path) > 1]
            out.append(pieces[pick])
            log += share
            node, depth = int(self.next[x + pick]), depth + 1
        return out, log

    def log_of(self, kind: int, path: tuple[int, ...]) -> float:
        node, log = int(self.first[kind]), 0.0
        for piece in path:
            edge = int(self.offset[node]) + self.piece[self.offset[node] : self.offset[node + 1]].tolist().index(piece)
            log += float(self.log[edge])
            node = int(self.next[edge])
        return log


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seeds: np.ndarray, turn: int, step: int) -> np.ndarray:
    """Numbers above 0 and below 1 by seed, turn and step."""
    mixed = _mix(seeds + np.uint64(((turn + 1) * 0x9E3779B97F4A7C15 + (step + 1) * 0xD1B54A32D192ED03) % (1 << 64)))
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _truncated(mass: np.ndarray, u: np.ndarray, top: float) -> np.ndarray:
    """Gumbel variables of the log masses given, conditioned on lying below top."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = mass - np.log(np.exp(mass - top) - np.log(u))
    return np.where(np.isfinite(mass), out, -np.inf)


class _Numbers(dict):
    def __missing__(self, stretch: str) -> int:
        self[stretch] = len(self)
        return self[stretch]


def sample_texts(pieces: Pieces, keys: list[int], texts: list[str], k: int, seed: int = 6) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k distinct segmentations, in falling order of their perturbed scores: piece ids, log probability
    and inclusion score. Texts with fewer segmentations give all; an empty text gives the empty one."""
    known = _Numbers()
    kinds = [np.array(list(map(known.__getitem__, STRETCH.findall(" " + t))), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    lattices = Lattices(pieces, list(known))
    sizes = np.array([len(x) for x in kinds], np.int64)
    offset = np.concatenate(([0], np.cumsum(sizes)))
    key = _mix(np.array([x & (2**64 - 1) for x in keys], np.uint64) + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64))
    place = np.arange(offset[-1]) - np.repeat(offset[:-1], sizes)
    seeds = _mix(np.repeat(key, sizes) + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    gumbel = -np.log(-np.log(uniform(key, 901, 0)))
    # Of each text: the segmentations found, as (pieces of each stretch, all pieces, log probability of each stretch),
    # and the regions, as (priorities, segmentation whose start is fixed, first stretch, paths found in that stretch).
    found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in texts]
    regions: list[list[tuple[np.ndarray, int, int, list]]] = [[] for _ in texts]
    todo = [(d, 0, -1, float(gumbel[d]), []) for d in range(len(texts)) if sizes[d]]
    for turn in range(k):
        if turn:
            todo = [x for d in range(len(texts)) if sizes[d] and (x := _next(d, regions[d], found[d])) is not None]
        if not todo:
            break
        spans = [(offset[d] + word, offset[d + 1]) for d, word, _, _, _ in todo]
        rows = np.concatenate([np.arange(a, b) for a, b in spans]) if turn else np.arange(offset[-1])
        every = np.concatenate(kinds)[rows] if turn else np.concatenate(kinds)
        counts, flat, log = lattices.sample(every, seeds[rows], turn)
        first = np.concatenate(([0], np.cumsum([b - a for a, b in spans])))
        edges = np.concatenate(([0], np.cumsum(counts)))
        before = [0.0] * len(todo)
        left = [None] * len(todo)
        for i, (d, word, of, _, banned) in enumerate(todo):
            lo, hi = first[i], first[i + 1]
            c, f, g = counts[lo:hi], flat[edges[lo] : edges[hi]], log[lo:hi]
            if turn:
                kind = int(every[lo])
                new = f[: c[0]].tolist()
                if tuple(new) in banned:
                    new, log[lo] = lattices.other(kind, banned, int(seeds[rows[lo]]), turn)
                taken = [*banned, tuple(new)]
                rest = 1 - sum(math.exp(lattices.log_of(kind, p)) for p in taken)
                left[i] = (-math.inf if len(taken) >= lattices.paths[kind] else math.log(max(1e-300, rest)), taken)
                old = found[d][of]
                start = int(old[0][:word].sum())
                f = np.concatenate((old[1][:start], new, f[c[0] :]))
                c, g = np.concatenate((old[0][:word], [len(new)], c[1:])), np.concatenate((old[2][:word], g))
                before[i] = float(old[2][:word].sum())
            found[d].append((c, f, g))
        total = np.cumsum(log)
        base = np.repeat(np.array(before) - (total[first[:-1]] - log[first[:-1]]), np.diff(first))
        with np.errstate(divide="ignore"):
            mass = total - log + base + np.log(-np.expm1(np.minimum(log, 0.0)))
        mass[lattices.paths[every] <= 1] = -np.inf
        for i in range(len(todo)) if turn else ():
            mass[first[i]] = before[i] + left[i][0]
        top = np.repeat(np.array([x[3] for x in todo]), np.diff(first))
        priority = _truncated(mass, uniform(seeds[rows], turn, 900), top)
        for i, (d, word, _, _, _) in enumerate(todo):
            regions[d].append((priority[first[i] : first[i + 1]], len(found[d]) - 1, word, left[i][1] if turn else []))
    out = []
    for d in range(len(texts)):
        if not sizes[d]:
            out.append([(np.zeros(0, np.int64), 0.0, 1.0)])
            continue
        threshold = max(float(r[0].max()) for r in regions[d])
        samples = []
        for _, f, g in found[d]:
            log_prob = float(g.sum())
            score = 1.0 if threshold == -np.inf else -math.expm1(-math.exp(min(700.0, log_prob - threshold)))
            samples.append((_expanded(pieces, f), log_prob, score))
        out.append(samples)
    return out


def _next(doc: int, regions: list[tuple], found: list[tuple]) -> tuple[int, int, int, float, list] | None:
    """The best region of a text, taken off: the text, the stretch that must differ, the segmentation whose start is fixed,
    the priority, and the paths that the stretch must not take."""
    tops = [int(r[0].argmax()) for r in regions]
    best = max(range(len(regions)), key=lambda i: regions[i][0][tops[i]])
    priority, of, first, taken = regions[best]
    at, top = tops[best], float(priority[tops[best]])
    if top == -np.inf:
        return None
    priority[at] = -np.inf
    return doc, first + at, of, top, taken if taken and not at else [_path(found[of], first + at)]


def _path(sample: tuple, word: int) -> tuple[int, ...]:
    start = int(sample[0][:word].sum())
    return tuple(int(x) for x in sample[1][start : start + int(sample[0][word])])


def _expanded(pieces: Pieces, flat: np.ndarray) -> np.ndarray:
    """Piece ids, with characters outside the vocabulary as the pieces of their bytes."""
    if not len(flat) or flat.min() >= 0:
        return flat
    parts, at = [], 0
    for i in np.flatnonzero(flat < 0).tolist():
        raw = chr(int(-2 - flat[i])).encode("utf-8", "surrogatepass")
        parts += [flat[at:i], pieces.byte_ids[np.frombuffer(raw, np.uint8)]]
        at = i + 1
    return np.concatenate([*parts, flat[at:]])


def _groups(keys: pd.Series, texts: pd.Series) -> Iterator[tuple[list[int], list[str]]]:
    ids, bodies, held = [], [], 0
    for key, text in zip(keys, texts, strict=True):
        ids.append(int(key)), bodies.append(text or "")
        held += len(bodies[-1])
        if held >= TOGETHER:
            yield ids, bodies
            ids, bodies, held = [], [], 0
    if ids:
        yield ids, bodies


def _udf(spark: SparkSession, model: bytes, k: int, digest: bool):
    shared = spark.sparkContext.broadcast(Pieces(model))
    kind = "n_pieces: array<int>, log_prob: array<double>, inclusion: array<double>"
    kind += ", ids_crc32: array<bigint>, round_trip: boolean" if digest else ", ids: array<array<int>>"

    names = [x.split(":")[0].strip() for x in kind.split(", ")]
    bounded_batches(spark)

    @pandas_udf(f"struct<{kind}>")
    def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pieces = shared.value
        for keys, texts in batches:
            rows = []
            for ids, bodies in _groups(keys, texts):
                for text, samples in zip(bodies, sample_texts(pieces, ids, bodies, k), strict=True):
                    row = [[len(s[0]) for s in samples], [s[1] for s in samples], [s[2] for s in samples]]
                    if digest:
                        row += [[zlib.crc32(s[0].astype("<i4").tobytes()) for s in samples], all(pieces.decode(s[0].tolist()) == text for s in samples)]
                    else:
                        row.append([s[0].astype(np.int32) for s in samples])
                    rows.append(row)
            yield pd.DataFrame(rows, columns=names)
        release()

    return encode


def encode_samples(documents: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", k: int = SAMPLES) -> DataFrame:
    """The documents with the struct `samples`: ids, the piece ids of up to k distinct segmentations, best perturbed score
    first, with n_pieces, log_prob and inclusion, the chance of a segmentation to be among the k given the threshold.

    Whole texts are encoded, and decoding any sample gives the text back exactly. Null and empty texts have one sample
    without pieces. Rows with the same key and text get the same samples, and ties of scores go by the order of the search;
    a null key counts as 0. Extra columns stay, whatever their names, and one named samples is replaced. An empty table
    gives an empty table.
    """
    return documents.withColumn("samples", _udf(documents.sparkSession, model, k, False)(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)), F.col(f"`{text}`")))


def read_model(tokenizers: str = TOKENIZERS) -> bytes:
    with open(f"{tokenizers}/piece_bpe_32k.model", "rb") as file:
        return file.read()


def op6_segmentation(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Sampled segmentations of every document: pieces, log probabilities, inclusion scores, checksums of the ids, and
    whether all of them decode to the text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = _udf(spark, read_model(tokenizers), SAMPLES, True)(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("text"))
    return documents.select("doc_id", made.alias("s")).select("doc_id", F.size("s.n_pieces").cast("long").alias("n_samples"), "s.*")


QUERIES = {"op6_segmentation": op6_segmentation}
SQL: dict[str, str] = {}
