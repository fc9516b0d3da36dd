"""LM scoring by a probabilistic suffix tree over word symbols.

Symbols: each word seen ``REPEATED`` times or more in training and the end of a
text are symbols of their own; any other word is a class by its last bytes, and
within its class it has the add-one share of its count. Contexts are the last
1..``DEPTH`` symbols. A context that occurs ``REPEATED`` times or more is a
candidate, at every size of the corpus, and a state of the tree if the log
likelihood that its next-symbol distribution gains over that of its suffix passes
half its parameters times the log of its count (or if a longer state needs it as
suffix). All its next symbols count, those seen once too. Each state's
distribution is smoothed with that of its suffix (Witten-Bell weights), down to
the root; a token is scored by the longest state that ends the text before it.

The tree stays in Spark. All contexts that end in the same word are one subtree,
which needs of the others only the probabilities of the root. So every token goes,
with the three symbols before it, to the bucket of the word before it; there the
subtrees are grown from the training tokens, all tokens are scored, and the sums
of each text go back to its rows. Buckets hold about ``BUCKET_TOKENS`` tokens. A
context followed by more than that ("hot") is dealt to several by the symbol before
it; they get the counts of its next symbols, made by a grouping of their own.
Words seen ``REPEATED`` times or more are broadcast to the tasks that read texts (a
hash and a symbol, 12 bytes each); symbols are numbered by falling count, so
counts and root probabilities are short lists of runs.

``Tree.levels`` is the most frequent part of the tree on the driver, read when it
is asked for and never used to score: contexts from ``least(tokens, CONTEXT_SCALE)``
and next symbols from ``least(tokens, ENTRY_SCALE)`` occurrences.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm._words import Roller, Words, as_long, map_texts, mix, slices, words
from pagesift.session import stage

DEPTH = 3
REPEATED = 2
CONTEXT_SCALE = 50
ENTRY_SCALE = 5000
CLASSES = 512
TAIL_BYTES = 2
END = 1  # the hash that stands for the end of a text
BUCKET_TOKENS = 1 << 20
SMALL_BUCKET = 1 << 16    # up to this, buckets are as many as shuffle partitions
CHUNK_TOKENS = 1 << 21    # tokens a task sends out at once
CHUNK_ROWS = 1 << 14
PROOF = 64                # a PROOFth of a hot context's longer ones is looked at first
TEXTS = 32                # texts whose rows pass the buckets together


def least(tokens: int, scale: float, floor: float = REPEATED) -> float:
    """Occurrences that keep at most scale * tokens ** (1/3) of what is read back
    to the driver (see ``Tree.levels``)."""
    return max(floor, tokens ** (2 / 3) / scale)


def held_out(id_col: Column, modulus: int = 7, remainder: int = 2) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def hashes(w: Words, roll: Roller) -> tuple[np.ndarray, np.ndarray]:
    """Hash and class of each word (lower-cased by the caller)."""
    h = roll.word_hashes(w)
    tail = roll.word_hashes(w._replace(start=np.maximum(w.start, w.end - TAIL_BYTES)))
    return as_long(h), (mix(tail) % np.uint64(CLASSES)).astype(np.int64)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in the sorted keys, -1 if absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def number(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, a place of each, and which of them each key is
    (``np.unique`` with half its memory)."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    which = np.empty(len(key), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return key[new], order[new], which


class Level(NamedTuple):
    """Contexts of one length. Context i has the key oldest symbol * (contexts
    one shorter) + place of its suffix there (the symbol itself at depth 1)."""
    contexts: np.ndarray  # keys, sorted
    spelled: np.ndarray   # symbols of each context, oldest first
    total: np.ndarray     # times the context was followed
    kinds: np.ndarray     # distinct next symbols
    keys: np.ndarray      # context * symbols + next symbol, sorted
    counts: np.ndarray
    state: np.ndarray     # whether the context is a state
    left: np.ndarray      # total + kinds - listed counts: the suffix's weight


class Tree(NamedTuple):
    tokens: int           # N
    types: int            # V
    head: np.ndarray      # hashes of the repeated words, sorted
    head_count: np.ndarray
    head_symbol: np.ndarray  # their symbols, the frequent ones first
    symbols: int
    root: np.ndarray      # probability of each symbol
    class_norm: np.ndarray  # log10 of (tokens + types + 1) of each class
    levels: Sequence      # frequent part, by depth
    docs: DataFrame       # the training rows are those of docs with train_on
    text_col: str
    train_on: Column | None


class Runs(NamedTuple):
    """Training counts of all symbols, which fall with the number of the symbol."""
    start: np.ndarray
    size: np.ndarray
    over: int             # tokens + symbols


class Hot(NamedTuple):
    """Contexts of one length dealt to several buckets, with what each needs."""
    key: np.ndarray       # place of the suffix among the hot ones * symbols + oldest symbol, sorted
    first: int            # number of the first one among the hot ones of all lengths
    spread: np.ndarray    # buckets of each
    total: np.ndarray
    kinds: np.ndarray
    grown: np.ndarray     # state by the divergence test
    state: np.ndarray     # or as suffix of a longer one


def size_of(symbol: np.ndarray, runs: Runs) -> np.ndarray:
    return runs.size[np.searchsorted(runs.start, symbol, side="right") - 1]


def sequence(w: Words, h: np.ndarray, cls: np.ndarray, head: np.ndarray, head_symbol: np.ndarray):
    """Symbols of all texts with their ends: (symbol, place in its text, text,
    place of the words in the sequence, place of the words in the head)."""
    n = len(w.offsets) - 1
    u, which = np.unique(h, return_inverse=True)
    at = find(head, u)[which]
    word = np.where(at >= 0, head_symbol[at] if len(head) else -1, 1 + cls)
    lengths = np.diff(w.first) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if n else np.zeros(0, np.int64)
    symbol = np.zeros(len(h) + n, np.int32)   # 0 is the end
    place = np.arange(len(h)) + w.doc
    symbol[place] = word
    return symbol, np.arange(len(symbol)) - np.repeat(starts, lengths), np.repeat(np.arange(n), lengths), place, at


def before(symbol: np.ndarray, pos: np.ndarray, d: int) -> np.ndarray:
    """The symbol d places before each in its text, -1 if there is none."""
    out = np.full(len(symbol), -1, np.int32)
    out[d:] = symbol[:-d] if d <= len(symbol) else out[d:]
    return np.where(pos >= d, out, np.int32(-1))


def count_words(docs: DataFrame) -> DataFrame:
    """(h, cls, n) of the training texts, ends included; docs: (rid.., text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for whole in batches:
            for b in slices(whole, "text"):
                w = words(b.column(0), lower=True)
                h, cls = hashes(w, roll)
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(u, END)), pa.array(np.append(cls[first], -1).astype(np.int16)), pa.array(np.append(n, b.num_rows))],
                    ["h", "cls", "n"])

    return map_texts(docs, run, "h long, cls short, n long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))


def probabilities(symbol: np.ndarray, ctx: list[np.ndarray], tree: Tree) -> np.ndarray:
    """Smoothed probability of each symbol by its longest state."""
    p = tree.root[symbol]
    for level, c in zip(tree.levels, ctx):
        at = np.flatnonzero(c >= 0)
        at = at[level.state[c[at]]]
        s = c[at]
        entry = find(level.keys, s * tree.symbols + symbol[at])
        n = np.where(entry >= 0, level.counts[entry] if len(level.counts) else 0, 0)
        p[at] = (n + level.left[s] * p[at]) / (level.total[s] + level.kinds[s])
    return p


def place_of(spelled: np.ndarray, levels: list) -> np.ndarray:
    """Place of contexts, given by their symbols, in the level of their length."""
    place = spelled[:, -1]
    for k in range(2, spelled.shape[1] + 1):
        place = find(levels[k - 1].contexts, spelled[:, -k] * len(levels[k - 2].contexts) + place)
    return place


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of four bytes, by their first, second.. bytes."""
    planes = b"".join(np.ascontiguousarray(c.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def spread(body: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(body[:8], "little")
    flat = np.frombuffer(pa.Codec("zstd").decompress(body[8:], 4 * n * columns, asbytes=True), np.uint8).reshape(columns, 4, n)
    return [np.ascontiguousarray(flat[k].T).view(np.int32).ravel() for k in range(columns)]


def hot_places(c: list, hots: list, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: which tokens follow a hot context, and its place."""
    at, place = np.arange(len(c[0])), np.zeros(len(c[0]), np.int64)
    for d, hot in enumerate(hots):
        place = np.where(c[d][at] >= 0, find(hot.key, place * symbols + c[d][at]), -1)
        at, place = at[place >= 0], place[place >= 0]
        yield at, place


def first_bucket(number: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(number.astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(buckets)).astype(np.int64)


def bucket_of(c: list, x: np.ndarray, buckets: int, hots: list, symbols: int) -> np.ndarray:
    """Bucket of each token by the symbol before it, after hot contexts by one symbol more."""
    to = (mix(c[0].astype(np.uint64) + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    for d, (at, place) in enumerate(hot_places(c, hots, symbols)):
        more = c[d + 1] if d + 1 < DEPTH else x
        deal = mix((more[at].astype(np.int64) + 2).view(np.uint64)) % hots[d].spread[place].astype(np.uint64)
        to[at] = (first_bucket(hots[d].first + place, buckets) + deal.astype(np.int64)) % buckets
    return to


class Grown(NamedTuple):
    """The contexts of one length in one bucket."""
    at: np.ndarray        # tokens that follow one
    context: np.ndarray   # and which
    entry: np.ndarray     # place of (context, token) in keys
    parent: np.ndarray    # suffix of each context
    last: np.ndarray      # oldest symbol of each context
    total: np.ndarray
    kinds: np.ndarray
    state: np.ndarray
    keys: np.ndarray      # context * symbols + next symbol, sorted
    counts: np.ndarray
    hot: np.ndarray       # place of each context among the hot ones, -1 if absent


def grow(c: list, x: np.ndarray, weight: np.ndarray, p: np.ndarray, symbols: int, depth: int, hots: list, hot_next: tuple) -> list[Grown]:
    """The contexts of one bucket. c: symbols one, two.. before each token x (-1:
    none), weight: 1 for training, p: root probability of x; hot_next: sorted
    numbers of hot contexts * symbols + next symbol, and their counts."""
    out, p = [], p.copy()
    at, parent, hot_parent = np.arange(len(x), dtype=np.int32), np.zeros(len(x), np.int32), np.zeros(1, np.int64)
    for d in range(depth):
        hot = hots[d]
        ok = c[d][at] >= 0
        at, parent = at[ok], parent[ok]
        key, _, context = number(parent.astype(np.int64) * symbols + c[d][at])
        total = np.bincount(context, weight[at], minlength=len(key))
        above = hot_parent[key // symbols]
        ready = np.where(above >= 0, find(hot.key, above * symbols + key % symbols), -1)
        shared = ready >= 0
        total[shared] = hot.total[ready[shared]]
        kept = total >= REPEATED
        ok = kept[context]
        at, context = at[ok], (np.cumsum(kept, dtype=np.int32) - np.int32(1))[context[ok]]
        key, total, ready, shared = key[kept], total[kept], ready[kept], shared[kept]
        entry, first, which = number(context.astype(np.int64) * symbols + x[at])
        owner = entry // symbols
        n = np.bincount(which, weight[at], minlength=len(entry))
        some = shared[owner]
        if some.any():
            found = find(hot_next[0], (hot.first + ready[owner[some]]) * symbols + entry[some] % symbols)
            n[some] = np.where(found >= 0, hot_next[1][found], 0)
        kinds = np.bincount(owner, n > 0, minlength=len(key))
        kinds[shared] = hot.kinds[ready[shared]]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.bincount(owner, np.where(n > 0, n * np.log(n / total[owner] / p[at[first]]), 0), minlength=len(key))
        state = gain > 0.5 * kinds * np.log(np.maximum(total, 2))
        state[shared] = hot.grown[ready[shared]]
        out.append(Grown(at, context, which, key // symbols, key % symbols, total, kinds, state, entry, n, ready))
        s = state[context]
        p[at[s]] = smoothed(out[-1], p, s)
        parent, hot_parent = context, ready
    for d in range(len(out) - 1, 0, -1):   # the suffixes of states are states
        out[d - 1].state[out[d].parent[out[d].state]] = True
    for g, hot in zip(out, hots):
        shared = np.flatnonzero(g.hot >= 0)
        g.state[shared] |= hot.state[g.hot[shared]]
    return out


def smoothed(g: Grown, p: np.ndarray, s: np.ndarray) -> np.ndarray:
    c = g.context[s]
    return (g.counts[g.entry[s]] + g.kinds[c] * p[g.at[s]]) / (g.total[c] + g.kinds[c])


def rows_of(grown: list[Grown], symbols: int, contexts: float, entries: float) -> pa.Table:
    """The frequent contexts (next symbol null) and next symbols of a bucket."""
    parts, spelled = [], np.zeros((1, 0), np.int64)
    for d, g in enumerate(grown):
        spelled = np.concatenate([g.last[:, None], spelled[g.parent]], axis=1)
        big, often = np.flatnonzero(g.total >= (contexts if d else 0)), np.flatnonzero((g.counts >= entries) & (g.counts > 0))
        often = often[g.total[g.keys[often] // symbols] >= contexts] if d else often
        for c, nxt, n in ((big, None, g.total[big]), (g.keys[often] // symbols, g.keys[often] % symbols, g.counts[often])):
            parts.append(pa.table({
                "spelled": pa.array(list(spelled[c]), pa.list_(pa.int64())), "next": pa.nulls(len(c), pa.int64()) if nxt is None else pa.array(nxt),
                "n": pa.array(n, pa.float64()), "kinds": pa.array(g.kinds[c], pa.float64()), "state": pa.array(g.state[c], pa.bool_())}))
    return pa.concat_tables(parts)


TEXT_COLUMNS = ["off", "id", "held_out", "n_tokens", "known", "base", "model", "rest"]


def text_schema(kind: str) -> str:
    return ("chunk long, body binary, off int, id " + kind + ", held_out boolean, n_tokens long, known long, base double, "
            "model double, rest array<struct<h:long,n:int>>")


def batch_of(columns: dict, schema: pa.Schema, n: int) -> pa.RecordBatch:
    """A batch of n rows; columns not given are null."""
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def arrow_schema(kind: pa.DataType, *more: pa.Field) -> pa.Schema:
    return pa.schema([*more, ("chunk", pa.int64()), ("body", pa.binary()), ("off", pa.int32()), ("id", kind), ("held_out", pa.bool_()),
                      ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()),
                      ("rest", pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())])))])


def after(c: list, hots: list, symbols: int, wanted: np.ndarray, share: int) -> np.ndarray:
    """Tokens that follow one of the hot contexts with these numbers, lengthened by
    a symbol out of one ``share``th of all: all tokens of each longer context."""
    mask = np.zeros(len(c[0]), bool)
    for d, (at, place) in enumerate(hot_places(c, hots, symbols)):
        if d + 1 < DEPTH:
            older = c[d + 1][at].astype(np.int64)
            mask[at[np.isin(hots[d].first + place, wanted) & (older >= 0) & (mix((older + 2).view(np.uint64)) // np.uint64(7) % np.uint64(share) == 0)]] = True
    return mask


def send(source: DataFrame, vocabulary, dealt, depth: int, only: tuple | None = None) -> DataFrame:
    """(bucket, chunk, body, a text's columns..): the tokens of the texts dealt to
    their buckets in bodies, and a row for each text to be scored, whose
    bucket is below 0. source: (id, held_out, text, trains, scored). only: of the
    tokens those ``after`` chooses (numbers, share)."""
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, head_symbol, symbols, class_norm), (buckets, runs, hots), roll = vocabulary.value, dealt.value, Roller()
        runs, hots = Runs(*runs), [Hot(*hot) for hot in hots]
        chunk, tokens, rows, held, schema = TaskContext.get().partitionId() << 24, 0, 0, [], None

        def flush():
            if not held:
                return
            b, *cols = zip(*held)
            b = np.concatenate(b)
            order = np.argsort(b, kind="stable")
            b, cols = b[order], [np.concatenate(c)[order] for c in cols]
            lead = np.concatenate([[0], 1 + np.flatnonzero(b[1:] != b[:-1])])
            for lo, hi in zip(lead.tolist(), [*lead[1:].tolist(), len(b)]):
                part = [c[lo:hi] for c in cols]
                part[-1] = np.diff(part[-1], prepend=0)
                yield batch_of({"bucket": pa.array([int(b[lo])]), "chunk": pa.array([chunk]), "body": pa.array([squeeze(*part)], pa.binary())}, schema, 1)

        for whole in batches:
            schema = schema or arrow_schema(whole.schema.field(0).type, ("bucket", pa.int64()))
            for batch in slices(whole, "text"):
                n = batch.num_rows
                w = words(batch.column(2), lower=True)
                h, cls = hashes(w, roll)
                symbol, pos, doc, place, at = sequence(w, h, cls, head, head_symbol)
                trains, scored = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), bool) for k in (3, 4))
                use = np.flatnonzero((pos > 0) & (trains | scored)[doc]) if depth else np.zeros(0, np.int64)
                c = [before(symbol, pos, d)[use] for d in range(1, DEPTH + 1)]
                if only:
                    chosen = after(c, hots, symbols, *only)
                    use, c = use[chosen], [x[chosen] for x in c]
                if len(use):
                    to = bucket_of(c, symbol[use], buckets, hots, symbols)
                    held.append((to.astype(np.uint16 if buckets < 1 << 16 else np.int64), *c, symbol[use],
                                 (trains + 2 * scored)[doc[use]].astype(np.int32), (rows + doc[use]).astype(np.int32)))
                size = np.log10(size_of(symbol, runs) + 1.0)
                logp = np.where((pos == 0) | (depth == 0), size - np.log10(runs.over), 0.0)
                known = at >= 0
                logp[place] -= np.where(known, 0.0, class_norm[cls])
                base = np.bincount(w.doc, np.where(known, size[place], 0.0), minlength=n).astype(float)
                tail = np.flatnonzero(~known)
                order = tail[np.lexsort((h[tail], w.doc[tail]))]
                d, k = w.doc[order], h[order]
                new = np.ones(len(order), bool)
                new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
                lead = np.flatnonzero(new)
                times = np.diff(np.append(lead, len(order)))
                off = np.searchsorted(d[lead], np.arange(n + 1)).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(k[lead]), pa.array(times.astype(np.int32))], ["h", "n"]))
                out = batch_of({
                    "bucket": pa.array(-1 - (chunk << 16) - (rows + np.arange(n)) // TEXTS), "chunk": pa.array(np.full(n, chunk)), "off": pa.array((rows + np.arange(n)).astype(np.int32)),
                    "id": batch.column(0), "held_out": batch.column(1), "n_tokens": pa.array(np.diff(w.first) + 1),
                    "known": pa.array(np.bincount(w.doc[known], minlength=n)), "base": pa.array(base),
                    "model": pa.array(np.bincount(doc, logp, minlength=n).astype(float)), "rest": rest}, schema, n)
                yield out.filter(pa.array(scored))
                tokens, rows = tokens + len(symbol), rows + n
                if tokens >= CHUNK_TOKENS or rows >= CHUNK_ROWS:
                    yield from flush()
                    chunk, tokens, rows, held = chunk + 1, 0, 0, []
        yield from flush()

    return map_texts(source, run, "bucket long, " + text_schema(kind))


def grow_buckets(sent: DataFrame, dealt, symbols: int, depth: int, buckets: int, then, schema: str) -> DataFrame:
    """``then(grown, bodies, root probabilities of the tokens, flags, text rows)`` for each
    bucket; rows of texts pass to ``then`` as they are, with None for the rest."""

    def run(key, table):
        if key[0].as_py() < 0:
            return then(None, None, None, None, table)
        runs, hots = Runs(*dealt.value[1]), [Hot(*hot) for hot in dealt.value[2]]
        bodies = [(c, x) for c, x in zip(table["chunk"].to_pylist(), table["body"].to_pylist())]
        nexts = [spread(x, 4) for c, x in bodies if c < 0]
        s, x, high, n = (np.concatenate(a).astype(np.int64) for a in zip(*nexts)) if nexts else (np.zeros(0, np.int64),) * 4
        n += high << 31
        order = np.argsort(s * symbols + x)
        bodies = [(c, spread(x, DEPTH + 3)) for c, x in bodies if c >= 0]
        *c, nxt, flag, off = (np.concatenate(a) for a in zip(*(b for _, b in bodies))) if bodies else (np.zeros(0, np.int32),) * (DEPTH + 3)
        lengths = np.array([len(b[0]) for _, b in bodies], np.int64)
        chunks = np.array([k for k, _ in bodies], np.int64)
        del bodies, nexts
        p = (size_of(nxt, runs) + 1) / runs.over
        grown = grow(c, nxt, (flag & 1).astype(float), p, symbols, depth, hots, ((s * symbols + x)[order], n[order]))
        return then(grown, (chunks, lengths, off), p, flag, table)

    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, schema)


def hot_next(texts: DataFrame, vocabulary, dealt, d: int) -> DataFrame:
    """(key, up, n): next symbols of the hot contexts of length d + 1 in the training
    texts; the key is the context's number * symbols + next symbol, up that of its suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, head_symbol, symbols, _), roll, held, tokens = vocabulary.value, Roller(), [], 0
        hots = [Hot(*hot) for hot in dealt.value[2]][:d + 1]
        up = hots[d].key // symbols + (hots[d - 1].first if d else 0)

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(up[key // symbols - hots[d].first] * symbols + key % symbols), pa.array(n)], ["key", "up", "n"])

        for whole in batches:
            for b in slices(whole, "text"):
                w = words(b.column(0), lower=True)
                symbol, pos, *_ = sequence(w, *hashes(w, roll), head, head_symbol)
                *_, (at, place) = hot_places([before(symbol, pos, k + 1).astype(np.int64) for k in range(d + 1)], hots, symbols)
                held.append((hots[d].first + place) * symbols + symbol[at])
                tokens += len(symbol)
                if tokens >= CHUNK_TOKENS:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    return map_texts(texts, run, "key long, up long, n long").groupBy("key", "up").agg(F.sum("n").alias("n"))


def hot_rows(table: DataFrame, symbols: int, targets: list, kind: str) -> DataFrame:
    """The counts of ``hot_next``, sent to each bucket that needs them (by number)."""
    to = table.sparkSession.sparkContext.broadcast(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush():
            key, n = (np.concatenate(a) for a in zip(*held))
            for c in np.unique(key // symbols).tolist():
                own = key // symbols == c
                body = squeeze(np.full(own.sum(), c), key[own] % symbols, n[own] >> 31, n[own] & 0x7FFFFFFF)
                for k in to.value[c]:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([body], pa.binary())], ["bucket", "body"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            rows += b.num_rows
            if rows >= BUCKET_TOKENS:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()

    got = table.select("key", "n").mapInArrow(run, "bucket long, body binary")
    return got.select("bucket", F.lit(-1).cast("long").alias("chunk"), "body", *(
        F.lit(None).cast(t).alias(c) for c, t in zip(TEXT_COLUMNS, ["int", kind, "boolean", "long", "long", "double", "double", "array<struct<h:long,n:int>>"])))


def hot_tested(table: DataFrame, hot: Hot, symbols: int, runs: Runs) -> tuple[Hot, DataFrame]:
    """The hot contexts with their counts and divergence test, and (key, p), the
    probability of each next symbol by them. table: (key, n, q), q: that
    of the suffix, or null for the root's."""

    def split(b: pa.RecordBatch):
        key, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(float)
        q = b.column(2).to_numpy(zero_copy_only=False).astype(float)
        return key, n, np.where(np.isnan(q), (size_of(key % symbols, runs) + 1) / runs.over, q)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n, q = split(b)
            c, which = np.unique(key // symbols, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.bincount(which, n)), pa.array(np.bincount(which).astype(float)),
                                              pa.array(np.bincount(which, n * np.log(n / q)))], ["c", "n", "kinds", "gain"])

    got = table.mapInArrow(parts, "c long, n double, kinds double, gain double").groupBy("c").agg(
        F.sum("n").alias("n"), F.sum("kinds").alias("kinds"), F.sum("gain").alias("gain")).toArrow()
    total, kinds, gain = (np.zeros(len(hot.key)) for _ in range(3))
    at = got["c"].to_numpy() - hot.first
    total[at], kinds[at], gain[at] = (got[k].to_numpy() for k in ("n", "kinds", "gain"))
    grown = gain - total * np.log(np.maximum(total, 1)) > 0.5 * kinds * np.log(np.maximum(total, 2))
    first = hot.first

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n, q = split(b)
            c = key // symbols - first
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.where(grown[c], (n + kinds[c] * q) / (total[c] + kinds[c]), q))], ["key", "p"])

    return hot._replace(total=total, kinds=kinds, grown=grown, state=grown.copy()), table.mapInArrow(chances, "key long, p double")


def prepare(tree: Tree, source: DataFrame, tokens: int, depth: int):
    """(rows for the buckets, how they are dealt, number of buckets) of the texts of ``source``,
    which hold about ``tokens`` tokens."""
    spark, s = source.sparkSession, tree.symbols
    kind = source.schema["id"].dataType.simpleString()
    some = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-tokens // BUCKET_TOKENS), min(some, tokens // SMALL_BUCKET))
    limit = min(BUCKET_TOKENS, max(4 * SMALL_BUCKET, tokens // 32))
    size = np.rint(tree.root * (tree.tokens + s) - 1)
    starts = np.flatnonzero(np.diff(size, prepend=-1))
    runs = Runs(starts, size[starts], tree.tokens + s)
    # Where the texts are more than the training ones, contexts are taken to be as frequent in them.
    scale = tokens / max(1, tree.tokens)
    fan = lambda n: np.minimum(buckets, 1 + n * scale // limit * 2).astype(np.int64)
    no, none = np.zeros(0, np.int64), np.zeros(0, bool)
    hots, spelled, tables = [Hot(no, 0, no, no, no, none, none)] * DEPTH, [], []
    vocabulary = spark.sparkContext.broadcast((tree.head, tree.head_symbol, s, tree.class_norm))

    def deal():
        return spark.sparkContext.broadcast((buckets, tuple(runs), [tuple(h) for h in hots]))

    words_of = [(int(k),) for k in np.flatnonzero(size * scale > limit) if k > 0] if depth else []
    counted = {k: size[k[0]] for k in words_of}
    chances = None
    for d in range(depth):
        if not counted:
            break
        keyed = sorted((spelled[-1].index(k[1:]) * s + k[0] if d else k[0], k) for k in counted)
        zeros = np.zeros(len(keyed))
        first = hots[d - 1].first + len(spelled[-1]) if d else 0
        hots[d] = Hot(np.array([k for k, _ in keyed]), first, fan(np.array([counted[k] for _, k in keyed])), zeros, zeros, zeros > 0, zeros > 0)
        spelled.append([k for _, k in keyed])
        table = stage(hot_next(training(tree), vocabulary, deal(), d), f"hot-next-{d + 1}")
        tables.append(table)
        with_q = table.withColumn("q", F.lit(None).cast("double")) if chances is None else table.join(
            chances.select(F.col("key").alias("up"), F.col("p").alias("q")), "up")
        hots[d], chances = hot_tested(with_q.select("key", "n", "q"), hots[d], s, runs)
        often = table.filter((F.col("n") * scale > limit) & (F.col("key") % s > 0)).select("key", "n").toArrow()
        counted = {(*spelled[-1][k // s - first], k % s): n for k, n in zip(often["key"].to_pylist(), often["n"].to_pylist())}
    dealt = deal()
    if not tables:
        return send(source, vocabulary, dealt, depth), dealt, buckets

    places = [sorted({(int(b) + k) % buckets for k in range(int(n))}) for hot in hots for b, n in
              zip(first_bucket(hot.first + np.arange(len(hot.key)), buckets), hot.spread)]
    for d in range(len(tables) - 1, 0, -1):   # what a longer context's buckets need too
        for k, up in enumerate((hots[d].key // s).tolist()):
            to = hots[d - 1].first + up
            places[to] = sorted({*places[to], *places[hots[d].first + k]})
    extra = hot_rows(tables[0], s, places, kind)
    for table in tables[1:]:
        extra = extra.unionByName(hot_rows(table, s, places, kind))
    number_of = np.concatenate([hot.first + np.arange(len(hot.key)) for hot in hots if len(hot.key)])
    for share in (PROOF, 1):
        # Is a hot context that is no state by itself the suffix of one? One such in a part of its
        # longer ones proves it; where there is none, all are looked at.
        left = number_of[~np.concatenate([hot.state for hot in hots])]
        if not len(left):
            break

        def needed(grown, bodies, p, flag, rows):
            return pa.table({"c": pa.array(np.concatenate([no, *(h.first + g.hot[(g.hot >= 0) & g.state] for g, h in zip(grown or [], hots))]), pa.int64())})

        texts = training(tree).select(F.lit(None).cast(kind).alias("id"), F.lit(False).alias("held_out"), "text", F.lit(True).alias("trains"), F.lit(False).alias("scored"))
        sent = send(texts, vocabulary, dealt, depth, (left, share)).unionByName(extra)
        found = grow_buckets(sent, dealt, s, depth, buckets, needed, "c long").distinct().toArrow()["c"].to_numpy()
        hots = [hot._replace(state=hot.state | np.isin(hot.first + np.arange(len(hot.key)), found)) for hot in hots]
        dealt = deal()
    return send(source, vocabulary, dealt, depth).unionByName(extra), dealt, buckets


def training(tree: Tree) -> DataFrame:
    return (tree.docs.filter(tree.train_on) if tree.train_on is not None else tree.docs).select(F.col(tree.text_col).alias("text"))


class Levels(Sequence):
    """The frequent part of the tree by depth, read from Spark when asked for."""

    def __init__(self, tree: Tree):
        self.tree, self.read = tree, None

    def __len__(self) -> int:
        return DEPTH if self.tree.tokens else 0

    def __getitem__(self, k):
        if self.read is None:
            self.read = frequent(self.tree) if self.tree.tokens else []
        return self.read[k]


def frequent(tree: Tree) -> list[Level]:
    texts = training(tree).select(F.lit(None).cast("long").alias("id"), F.lit(False).alias("held_out"), "text", F.lit(True).alias("trains"), F.lit(False).alias("scored"))
    sent, dealt, buckets = prepare(tree, texts, tree.tokens, DEPTH)
    contexts, entries, s = least(tree.tokens, CONTEXT_SCALE), least(tree.tokens, ENTRY_SCALE, 1), tree.symbols

    def then(grown, bodies, p, flag, rows):
        return rows_of(grown or [], s, contexts, entries) if grown else pa.table(
            {"spelled": pa.nulls(0, pa.list_(pa.int64())), "next": pa.nulls(0, pa.int64()), "n": pa.nulls(0, pa.float64()),
             "kinds": pa.nulls(0, pa.float64()), "state": pa.nulls(0, pa.bool_())})

    rows = grow_buckets(sent, dealt, s, DEPTH, buckets, then, "spelled array<long>, next long, n double, kinds double, state boolean").distinct().toArrow()
    size = rows["spelled"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, int)
    levels: list[Level] = []
    for d in range(1, DEPTH + 1):
        part = rows.filter(pa.array(size == d))
        spelled = part["spelled"].combine_chunks().flatten().to_numpy().reshape(-1, d) if part.num_rows else np.zeros((0, d), np.int64)
        n, kinds, state = (part[k].to_numpy() for k in ("n", "kinds", "state"))
        nxt = part["next"].fill_null(-1).to_numpy()
        key = spelled[:, 0] if d == 1 else spelled[:, 0] * len(levels[-1].contexts) + place_of(spelled[:, 1:], levels)
        of = nxt < 0
        if d == 1:
            keys, spells = np.arange(s), np.arange(s)[:, None]
        else:
            order = np.argsort(key[of])
            keys, spells = key[of][order], spelled[of][order]
        total, many, is_state = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = find(keys, key[of])
        total[at], many[at], is_state[at] = n[of], kinds[of], state[of]
        entry = find(keys, key[~of]) * s + nxt[~of]
        order = np.argsort(entry)
        entry, counts = entry[order], n[~of][order]
        listed = np.bincount(entry // s, counts, minlength=len(keys))[:len(keys)]
        levels.append(Level(keys, spells, total, many, entry, counts, is_state, total + many - listed))
    return levels


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_on: Column | None = None) -> tuple[Tree, DataFrame]:
    """The symbols and root of the tree, and the counts (h, cls, n) of all training
    words, written to the shared folder. ``train_on`` selects the training rows
    (default: all). The longer contexts are grown where texts are scored."""
    texts = (docs.filter(train_on) if train_on is not None else docs).select(F.col(text_col).alias("text"))
    counts = stage(count_words(texts), "word-counts")
    row = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types")).first()
    tokens, types = row["tokens"] or 0, row["types"]
    head = counts.filter((F.col("n") >= REPEATED) & (F.col("h") != END)).select("h", "n").toArrow()
    h, n = head["h"].to_numpy(), head["n"].to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    symbol = np.zeros(len(h), np.int32)
    symbol[np.argsort(-n, kind="stable")] = 1 + CLASSES + np.arange(len(h))
    symbols = 1 + CLASSES + len(h)
    rare = counts.filter((F.col("n") < REPEATED) & (F.col("h") != END)).groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).toArrow()
    cls = rare["cls"].to_numpy().astype(np.int64)
    size = np.zeros(symbols)
    norm = np.ones(CLASSES)
    size[1 + cls] = rare["n"].to_numpy()
    norm[cls] += rare["n"].to_numpy() + rare["types"].to_numpy()
    size[symbol] = n
    size[0] = tokens - size[1:].sum()  # the ends
    tree = Tree(tokens, types, h, n, symbol, symbols, (size + 1) / (tokens + symbols), np.log10(norm), [], docs, text_col, train_on)
    return tree._replace(levels=Levels(tree)), counts


def score(df: DataFrame, tree: Tree, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          held: Column | None = None) -> DataFrame:
    """Base and model score of every whole text.

    Returns (id, held_out, n_tokens, n_known, train_tokens, base_score, score),
    one row per input row; scores are log10 probabilities, the end of the text
    included.

    Defined cases: null and empty texts consist of their end; a null id is
    passed through; repeated rows are scored each; without training tokens the
    base is 1 / 1 for every token (score 0) and the tree only has its root;
    an empty table gives no rows; other columns are ignored.
    """
    depth = len(tree.levels)
    flag = lambda c, default: F.coalesce(c, F.lit(False)) if c is not None else F.lit(default)
    same = df is tree.docs and text_col == tree.text_col   # each text is then sent once
    source = df.select(F.col(id_col).alias("id"), (held if held is not None else F.lit(False)).alias("held_out"), F.col(text_col).alias("text"),
                       (flag(tree.train_on, True) if same else F.lit(False)).alias("trains"), F.lit(True).alias("scored"))
    kind = source.schema["id"].dataType.simpleString()
    tokens = tree.tokens
    if not same and depth:
        sizes = [d.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for d in (source, training(tree))]
        tokens = int(tokens * (1 + sizes[0] / max(1, sizes[1])))
        source = source.unionByName(training(tree).select(
            F.lit(None).cast(kind).alias("id"), F.lit(False).alias("held_out"), "text", F.lit(True).alias("trains"), F.lit(False).alias("scored")))
    sent, dealt, buckets = prepare(tree, source, tokens, depth)

    def then(grown, bodies, p, flag, rows):
        if grown is None:
            return rows.drop_columns(["bucket"])
        schema = arrow_schema(rows.schema.field("id").type)
        for g in grown:
            s = g.state[g.context]
            p[g.at[s]] = smoothed(g, p, s)
        logp, out = np.where(flag & 2, np.log10(p), 0.0), []
        lo = 0
        for c, n, in zip(bodies[0].tolist(), bodies[1].tolist()):
            step = bodies[2][lo:lo + n]
            new = step > 0
            new[0] = True
            lead = np.flatnonzero(new)
            sums = np.add.reduceat(logp[lo:lo + n], lead)
            at = np.cumsum(step)[lead].astype(np.int32)
            body = len(at).to_bytes(8, "little") + at.tobytes() + sums.tobytes()
            out.append(batch_of({"chunk": pa.array([c]), "body": pa.array([body], pa.binary())}, schema, 1))
            lo += n
        return pa.Table.from_batches(out, schema)

    def back(key, table):
        rows = table.filter(table["body"].is_null())
        off = rows["off"].to_numpy()
        more = np.zeros(int(off.max()) + 1 if len(off) else 0)
        for body in table["body"].drop_null().to_pylist():
            n = int.from_bytes(body[:8], "little")
            at, sums = np.frombuffer(body, np.int32, n, 8), np.frombuffer(body, np.float64, n, 8 + 4 * n)
            ok = at < len(more)
            more[at[ok]] += sums[ok]
        model = pa.array(rows["model"].to_numpy() + more[off])
        rid = pa.array((key[0].as_py() << 20) + off.astype(np.int64))
        return pa.table([rid, *(rows[c] for c in ("id", "held_out", "n_tokens", "known", "base")), model, rows["rest"]],
                        names=["rid", "id", "held_out", "n_tokens", "known", "base", "model", "rest"])

    summed = grow_buckets(sent, dealt, tree.symbols, depth, buckets, then, text_schema(kind))
    rows = stage(summed.groupBy("chunk").applyInArrow(
        back, f"rid long, id {kind}, held_out boolean, n_tokens long, known long, base double, model double, rest array<struct<h:long,n:int>>"), "scored")
    # The rare words of each text get their counts by a join.
    small = counts.filter((F.col("n") < REPEATED) & (F.col("h") != END)).select("h", F.col("n").alias("c"))
    rare = rows.select("rid", F.explode("rest").alias("r")).select("rid", F.col("r.h").alias("h"), F.col("r.n").alias("n"))
    found = rare.join(small, "h").groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("known_more"))
    ends = counts.filter(F.col("h") == END).agg(F.sum("n")).first()[0] or 0
    total = float(tree.tokens + tree.types + 1)
    out = rows.drop("rest").join(found, "rid", "left").fillna(0, ["more", "known_more"])
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("known") + F.col("known_more") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(tree.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(total)))).alias("base_score"),
        (F.col("model") + F.col("more")).alias("score"))
