"""Sequence packing by non-negative least squares over the length histogram.

Every document is tokenised once. Full windows are cut off its start; the rest (the tail) is packed whole where a pattern
takes it. The driver sees the histogram of tail lengths alone (one count a length, whatever the corpus): it enumerates
shallow combinations of lengths that fill a window, solves their repeat counts by non-negative least squares, rounds them
down to what the histogram holds, and packs what is left greedily. Tails that greedy patterns would leave padding for are
cut into parts of powers of two, which fill windows (or sequences of a power of two) exactly. The plan is a list of
intervals of ranks within a length, so a piece finds its sequence by arithmetic from its rank; ranks come from counts of
salted groups. Only piece headers are shuffled, never tokens.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, cut, once, pieces, text_batches, trimmed

#: Tokens in a sequence (a power of two).
CAPACITY = 1024
#: Most lengths in an enumerated combination, and the step of the lengths that three-part combinations use.
DEPTH, STEP = 3, 16
#: Padding that a greedy pattern may leave; tails that would leave more are cut.
SLACK = 0
#: Pieces for each salt of the groups that ranks are counted in, and the most salts.
GROUP, SALTS = 4_000, 65_536
END = 0
#: Characters in a run of blanks, or of anything else, from which on a text goes to the `tokenizers` library.
LONG_RUN = 2_000
BLANKS = re.compile(rf"\s{{{LONG_RUN}}}")

PIECE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                      T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
                      T.StructField("parts", T.ArrayType(T.LongType()))])


def merged(parts: list[bytes], rules: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Byte-pair encoding of one word by the rules themselves: the rule of least rank first, leftmost first."""
    while len(parts) > 1:
        rank, at = min((rules.get(pair, len(rules)), i) for i, pair in enumerate(zip(parts, parts[1:])))
        if rank == len(rules):
            break
        parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
    return parts


@functools.lru_cache(maxsize=8)
def ranked_by_id(path: str) -> bool:
    """Whether a plain byte-level file may be run by ids as ranks of whole tokens. Three things must hold: rules come in the
    order of their tokens' ids; every token but the bytes comes from a rule; and every token, cut into bytes, is merged back
    into itself. Then two neighbours that make up a token always are what its rule joins: nothing was merged across the
    token's ends, so its bytes went through the same merges as they do alone, and those end in the token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    code, special = byte_codes(), {t["content"] for t in spec.get("added_tokens", [])}
    decode = lambda t: bytes(code[c] for c in t)
    rules = {}
    for rule in model["merges"]:
        a, b = rule.split(" ") if isinstance(rule, str) else rule
        rules[decode(a), decode(b)] = len(rules)
    ids = {decode(t): i for t, i in model["vocab"].items() if t not in special}
    made = [ids.get(a + b, -1) for a, b in rules]
    if made != sorted(set(made)) or -1 in made or set(ids) != {bytes([b]) for b in range(256)} | {a + b for a, b in rules}:
        return False
    if max(ids[bytes([b])] for b in range(256)) > min(made, default=256):
        return False
    return all(len(t) < 3 or merged([t[i : i + 1] for i in range(len(t))], rules) == [t] for t in ids)


def byte_codes() -> dict[str, int]:
    """Byte-level files write a byte as the character of its code if that is printable, the others from U+0100 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


def has_long_run(text: str) -> bool:
    """Whether LONG_RUN characters on end are blank, or none of them is. Such a run covers one whole block of half as many, so
    a text is searched only if a block is blank or without a blank."""
    half = LONG_RUN // 2
    for at in range(0, len(text) - half + 1, half):
        block = text[at : at + half]
        if " " not in block or block.isspace():
            return bool(BLANKS.search(text)) or max(map(len, text.split()), default=0) >= LONG_RUN
    return False


class Encoder:
    """Token ids of a file of the `tokenizers` library (add_special_tokens=False).

    Where `fast` (see ranked_by_id) holds, a faster BPE runs over the same vocabulary. Texts that hold a special token's
    string or a run of LONG_RUN blanks or other characters (the faster one's patterns recurse, its merges are quadratic), and
    all other files, go to `tokenizers` itself. tests/llm holds both against each other.
    """

    #: Fixed value: the word pattern of byte-level BPE, as public_tokenizers gives it.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, fast: bool | None = None):
        fast = ranked_by_id(path) if fast is None else fast
        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranks(spec["model"]["vocab"]) if fast else None

    def _ranks(self, vocab: dict[str, int]) -> object:
        import tiktoken

        code = byte_codes()
        ranks = {bytes(code[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("bytes", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special) or has_long_run(text):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)  # type: ignore[attr-defined]


def powers(length: int) -> list[int]:
    """The powers of two that add up to a length, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def cutter(path: str, capacity: int, fast: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Headers of every document's pieces: full windows, then the tail with the checksums of its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once(f"encoder {path}", lambda: Encoder(path, fast))
        for whole in batches:
            for batch in pieces(whole):
                rows: list[tuple] = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = np.array([*(encode(text) if text else ()), END], "<u4")
                    n = len(ids)
                    for at in range(0, n, capacity):
                        piece = ids[at : at + capacity]
                        parts, to = [], 0
                        for p in powers(len(piece)) if len(piece) < capacity else []:
                            parts.append(zlib.crc32(piece[to : to + p].tobytes()))
                            to += p
                        rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), n, parts))
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.list_(pa.int64()) if k == 5 else pa.int64()) for k, c in enumerate(columns)], [f.name for f in PIECE.fields]
                )

    return run


def combinations(histogram: np.ndarray, capacity: int, depth: int = DEPTH, step: int = STEP) -> list[tuple[int, ...]]:
    """Ascending tuples of up to `depth` lengths that add up to the window, of lengths that occur: all pairs, and triples
    whose two smaller lengths are multiples of `step`. At most capacity/2 + (capacity/step)**2 of them."""
    has = histogram > 0
    out = [(a, capacity - a) for a in range(1, capacity // 2 + 1) if has[a] and has[capacity - a]]
    if depth >= 3:
        grid = [a for a in range(step, capacity, step) if has[a]]
        out += [(a, b, capacity - a - b) for a in grid for b in grid if a <= b <= capacity - a - b and has[capacity - a - b]]
    return out


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """argmin over x >= 0 of |A x - target|, A counting a combination's lengths: accelerated projected gradient with restarts.
    Columns hold at most DEPTH lengths, so a product with A costs a few gathers."""
    if not columns:
        return np.zeros(0)
    width = max(map(len, columns))
    index = np.array([[*c, *[0] * (width - len(c))] for c in columns])
    real = (index > 0).astype(float)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(index.ravel(), (real * x[:, None]).ravel(), len(target))

    def back(r: np.ndarray) -> np.ndarray:
        return (r[index] * real).sum(1)

    v = np.ones(len(columns))
    for _ in range(30):  # power method for the largest eigenvalue of A'A
        v = back(forward(v / np.linalg.norm(v)))
    rate = 1 / (1.02 * np.linalg.norm(v))
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        gradient = back(forward(y) - target)
        new = np.maximum(0, y - rate * gradient)
        if gradient @ (new - x) > 0:
            y, t = x, 1.0
            new = np.maximum(0, x - rate * back(forward(x) - target))
        step = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / step * (new - x), new, step
    return x


def plan_of(histogram: dict[int, int], capacity: int = CAPACITY, depth: int = DEPTH, step: int = STEP) -> dict[str, object]:
    """Patterns [(lengths, repeats)] that together take every tail once, whole or as parts: `whole` patterns, the lengths
    (`split`) whose tails beyond those are cut into powers of two, and `last` sequences of those parts."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    whole: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        whole.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    names = combinations(left, capacity, depth, step)
    for k in np.argsort(-(x := nnls(names, left.astype(float))), kind="stable"):
        times, need = int(x[k] + 0.5), np.unique(names[k], return_counts=True)
        times = min(times, int((left[need[0]] // need[1]).min()))
        if times > 0:
            whole.append((names[k], times))
            left[need[0]] -= times * need[1]
    # What rounding and lengths without a partner leave: largest first, then the largest that still fits, as often as it goes.
    blocked = np.zeros(capacity + 1, bool)
    while True:
        open_ = np.flatnonzero((left > 0) & ~blocked)
        if not len(open_):
            break
        use: list[int] = [int(open_[-1])]
        spare, held = left.copy(), capacity - use[0]
        spare[use[0]] -= 1
        while held:
            fit = np.flatnonzero(spare[: held + 1] > 0)
            if not len(fit):
                break
            use.append(int(fit[-1]))
            spare[fit[-1]] -= 1
            held -= int(fit[-1])
        if held > SLACK:
            blocked[use[0]] = True
            continue
        need = np.unique(use, return_counts=True)
        times = int((left[need[0]] // need[1]).min())
        whole.append((tuple(use), times))
        left[need[0]] -= times * need[1]
    split = {int(n): int(left[n]) for n in np.flatnonzero(left)}
    parts: dict[int, int] = {}
    for n, c in split.items():
        for p in powers(n):
            parts[p] = parts.get(p, 0) + c
    return {"whole": whole, "split": split, "parts": parts, "capacity": capacity}


def layout(plan: dict) -> dict[str, object]:
    """Ranks of whole tails and of parts, turned into sequences. For each length: interval starts, first sequence, uses in
    the pattern and offset in it. Parts of a power of two follow each other, large to small, in one gapless stream."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan["whole"]:
        offset = 0
        for n, uses in zip(*(v.tolist() for v in np.unique(lengths, return_counts=True))):
            table.setdefault(n, []).append((taken.get(n, 0), sequence, uses, offset))
            taken[n] = taken.get(n, 0) + uses * times
            offset += uses * n
        sequence += times
    base, at = {}, 0
    for p in sorted(plan["parts"], reverse=True):
        base[p] = at
        at += p * plan["parts"][p]
    prior: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for n in sorted(plan["split"]):
        for p in powers(n):
            prior[n, p] = seen.get(p, 0)
            seen[p] = seen.get(p, 0) + plan["split"][n]
    # The stream's last window is short: its binary parts make sequences of a power of two each.
    full, rest = divmod(at, plan["capacity"])
    ends, where = [], full * plan["capacity"]
    for k, p in enumerate(powers(rest)):
        ends.append((where, sequence + full + k))
        where += p
    return {"table": table, "taken": taken, "sequence": sequence, "base": base, "prior": prior, "last": ends, "full": full, "capacity": plan["capacity"]}


def place(rows: dict[str, np.ndarray], lay: dict) -> dict[str, np.ndarray]:
    """Output rows of pieces of known rank."""
    out: dict[str, list] = {c: [] for c in ("source", "start", "length", "ids_crc32", "sequence_id", "offset")}
    capacity, ends = lay["capacity"], np.array([a for a, _ in lay["last"]], np.int64)
    length, rank = rows["length"], rows["rank"]
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        r = rank[at]
        whole = r < lay["taken"].get(n, 0)
        if whole.any():
            steps = np.array(lay["table"][n], np.int64)
            k = np.searchsorted(steps[:, 0], r[whole], side="right") - 1
            i, uses = r[whole] - steps[k, 0], steps[k, 2]
            out["source"].append(at[whole])
            out["start"].append(rows["start"][at[whole]])
            out["length"].append(np.full(whole.sum(), n))
            out["ids_crc32"].append(rows["ids_crc32"][at[whole]])
            out["sequence_id"].append(steps[k, 1] + i // uses)
            out["offset"].append(steps[k, 3] + i % uses * n)
        if not whole.all():
            own, over, to = at[~whole], r[~whole] - lay["taken"].get(n, 0), 0
            for j, p in enumerate(powers(n)):
                token = lay["base"][p] + (lay["prior"][n, p] + over) * p
                sequence, offset = lay["sequence"] + token // capacity, token % capacity
                if len(ends):
                    late = token >= ends[0]
                    k = np.searchsorted(ends, token[late], side="right") - 1
                    sequence[late] = np.array([s for _, s in lay["last"]])[k]
                    offset[late] = token[late] - ends[k]
                out["source"].append(own)
                out["start"].append(rows["start"][own] + to)
                out["length"].append(np.full(len(own), p))
                out["ids_crc32"].append(np.array([rows["parts"][i][j] for i in own], np.int64))
                out["sequence_id"].append(sequence)
                out["offset"].append(offset)
                to += p
    return {c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()}


def pack(documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `tokenizer` is the path of a vocabulary file of the `tokenizers` library, readable on every executor. Each document's
    ids end with an id 0; a null or empty text is that id alone. Every id lies in exactly one piece; a sequence holds
    `capacity` tokens, or a smaller power of two, so no padding arises (except where whole greedy patterns allow SLACK).
    Rows that repeat (also a doc_id) are packed one by one; a null doc_id stays null; further columns are not read. Ties of
    rank are broken by doc_id, start and checksum, so pieces that tie are equal. An empty table gives no rows.
    """
    if capacity & (capacity - 1) or capacity < 2:
        raise ValueError("the capacity must be a power of two")
    spark = documents.sparkSession
    text_batches(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    heads = cut(docs.mapInArrow(trimmed(cutter(tokenizer, capacity, ranked_by_id(tokenizer))), PIECE))
    total = heads.count()
    groups = min(SALTS, max(32, total // GROUP))
    salted = heads.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cut(counts.withColumn("before", before), min(total, groups * capacity))
    histogram = {r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("n").alias("c")).collect()}  # one row a length
    lay = layout(plan_of(histogram, capacity))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("place", F.row_number().over(order) - 1)
    side = counts.select("length", "salt", "before")
    ranked = ranked.join(F.broadcast(side) if groups * capacity <= BROADCAST_ROWS // 4 else side, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("place"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "length", "ids_crc32", "rank")}
            rows["parts"] = batch.column("parts").to_pylist()
            got = place(rows, lay)
            source = pa.array(got.pop("source"))
            arrays = {c: pa.array(v, pa.int64()) for c, v in got.items()} | {c: batch.column(c).take(source) for c in ("doc_id", "doc_tokens")}
            yield pa.RecordBatch.from_arrays([arrays[f.name] for f in schema.fields], [f.name for f in schema.fields])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts", "rank").mapInArrow(run, schema)
