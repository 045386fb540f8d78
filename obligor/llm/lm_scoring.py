"""Language-model scores: online logistic mixing of hashed-context bit predictors.

A text is modelled as its tokens: lower-cased words with a blank between them and a line
feed for the end. Every byte is eight binary choices. For each of the ``ORDERS`` + 1
contexts (the last 0 to 6 bytes) a slot of (context, bits so far) counts zeros and
ones; each count pair is a log odds. Two gates, the longest context with a count and the
place in the word, each with the bits so far, pick sets of weights; the sum of the log
odds, weighted by both sets, is the mixed prediction. It is refined by a table, adapted to
how often the bit came true for a like prediction after like bits, and both are averaged.
The bits' probabilities multiply to a proper distribution over texts; their sum of
logarithms is the score.

A window is the longest context and the byte after it. Documents are packed into blocks;
a block lists each distinct window and word once, dealt into buckets by a hash of the last
three bytes of the context (of the word). So all that longer contexts have in common meets
in one bucket, whose slots are exact and as many as its windows need; only contexts of at
most ``SHARED`` bytes span buckets, and their slots are as many as there are such contexts,
whatever the corpus: that is what is broadcast. Weights are learnt online over the distinct
windows of each bucket, batch after batch, each predicted before it is learnt from and with
its own occurrence taken out of the counts; buckets learn side by side and their weights
are averaged, ``ROUNDS`` times. Then each distinct window is scored once and its score goes
back to the blocks that hold it. Buckets follow the bytes of the table, never a session
setting or an input split, and what is summed across tasks is whole numbers (or multiples of
2 ** -16, exact up to 2 ** 37): a score is a function of the rows alone.

The base score takes words as they are, from exact counts over the whole corpus.

Defined results: a null or empty text is the end alone; rows without an id are scored, not
learnt from and not held out; repeated rows are counted and scored each; with nothing to
learn from every token has base probability 1 and the model is close to uniform; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obligor.llm.blocks import planes, unplaned
from obligor.llm.words import texts_of, words_of
from obligor.session import pin

ORDERS = 6
#: Contexts up to this many bytes are counted across buckets.
SHARED = 2
ROUNDS = 2
#: Learning rate of the first round; it falls with each. Steps follow Adagrad.
RATE = 0.02
#: Counts added to zeros and ones.
PRIOR = 0.4
#: Windows of one learning step, and of one scoring step.
_STEP, _SCORED = 1024, 1 << 15
#: Bytes of text after which a block is closed, and bytes whose windows are listed at a time.
BLOCK_BYTES, _PART_BYTES = 8_000_000, 1_000_000
#: Windows that a block sorts at a time.
_SORTED = 9_000_000
#: Bytes of the table for each bucket, and the smallest number of buckets.
BUCKET_BYTES, _BUCKETS = 16_000_000, 16
#: Places in which a block looks up its windows, and those that lost theirs, before it searches.
_PLACE_BITS, _SECOND_BITS = 22, 20
_SPREAD, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: Steps of a window's score, in each unit of log10.
_UNIT = 1 << 14
#: Steps to which weights are rounded before they are added up.
_EXACT = 1 << 16
_PAD = b"\n" * ORDERS
_CHUNK_BITS = 16
_BINS, _REACH = 33, 8.0
_NODES = 256
_GATES = (ORDERS + 1) * _NODES
_CERTAIN = 1e-6


def canonical(text: bytes) -> bytes:
    """The tokens of a text as the model reads them."""
    return b" ".join(words_of(text)) + b"\n"


def window_parts(
    texts: list[bytes], part_bytes: int = _PART_BYTES
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of canonical texts and the number of the text each belongs to, in bounded parts.

    A window holds the bytes before, the last one highest, and the byte to come lowest.
    """
    held: list[bytes] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        whole = _PAD + text
        for at in range(0, len(whole) - ORDERS, part_bytes):
            held.append(whole[at : at + part_bytes + ORDERS])
            owners.append(i)
            size += len(held[-1])
            if size >= part_bytes:
                yield _windows(held, owners)
                held, owners, size = [], [], 0
    if held:
        yield _windows(held, owners)


def _windows(pieces: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(piece) for piece in pieces])
    n = data.size - ORDERS
    keys = np.zeros(n, np.uint64)
    for back in [*range(1, ORDERS + 1), 0]:
        keys <<= np.uint64(8)
        keys |= data[ORDERS - back : ORDERS - back + n]
    # The last bytes of a piece are no windows of their own: those would cross into the next.
    whole = np.ones(data.size, bool)
    ends = np.cumsum(lengths)
    whole[(ends[:, None] - 1 - np.arange(ORDERS)).ravel()] = False
    return keys[whole[:n]], np.repeat(np.array(owners), lengths - ORDERS)


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins among ordered ones."""
    return np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = _starts(keys)
    return keys[starts], np.add.reduceat(counts, starts) if starts.size else counts


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def _tight(data: bytes) -> bytes:
    """Compressed, so that rows stay small in the JVM as well."""
    return zstandard.ZstdCompressor(level=1).compress(data)


def _loose(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _numbers(values: np.ndarray) -> bytes:
    return _tight(planes(values, 8))


def _from_numbers(data: bytes) -> np.ndarray:
    return unplaned(_loose(data), 8)


def _rising(keys: np.ndarray) -> bytes:
    """Ordered keys as their differences, which compress well."""
    return _numbers(np.diff(keys, prepend=keys.dtype.type(0)))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(_from_numbers(data)).astype(np.uint64)


def listed(texts: list[bytes], learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of canonical texts in order, and how often texts to learn from hold them."""
    learnt = learnt.astype(np.uint64)
    held, marked, size = [], [], 0
    for keys, owner in window_parts(texts):
        keys <<= np.uint64(1)
        keys |= learnt[owner]
        marked.append(keys)
        size += keys.size
        # One sort of a whole block is faster than parts that are merged; longer texts stay bounded.
        if size >= _SORTED:
            held.append(_marked(marked))
            marked, size = [], 0
    if marked:
        held.append(_marked(marked))
    return held[0] if len(held) == 1 else _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _marked(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows in order and how often each is marked by its lowest bit; empties ``parts``."""
    windows = np.concatenate(parts)
    parts.clear()
    windows.sort()
    starts = np.flatnonzero((windows[1:] ^ windows[:-1]) > 1) + 1
    starts = np.concatenate([[0], starts])
    keys = windows[starts] >> np.uint64(1)
    windows &= np.uint64(1)
    return keys, np.add.reduceat(windows, starts).astype(np.int64)


def pack(rows: DataFrame) -> DataFrame:
    """(block, doc_ids, texts, learnt, bytes, ends): canonical texts in blocks, each line one, in the shared folder.

    ``rows`` holds doc_id, text and learnt, whether a row is learnt from.
    """
    schema = "block long, doc_ids array<long>, texts binary, learnt array<boolean>, bytes long, ends long"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            doc_ids, texts, learnt = (list(x) for x in zip(*held, strict=True))
            row = (number, doc_ids, _tight(b"".join(texts)), learnt, size, sum(learnt))
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.bool_()), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            columns = batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), batch.column("learnt").to_pylist()
            for doc_id, text, learnt in zip(*columns, strict=True):
                held.append((doc_id, canonical(text), learnt))
                size += len(held[-1][1])
                if size >= BLOCK_BYTES:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return pin(rows.select("doc_id", "text", "learnt").mapInArrow(run, schema), "texts")


def _by_bucket(terms: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, and the order of the words by bucket."""
    bucket = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % buckets
    return bucket, np.argsort(bucket, kind="stable")


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Windows with the same last three bytes of context share a bucket."""
    return (_mixed(keys >> np.uint64(8 * (ORDERS - 2))) >> np.uint64(33)).astype(np.int64) % buckets


def bucketed(packed: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: its distinct windows and their counts, the blocks that hold any of it,
    the places of their windows among the bucket's, how often each block's words occur in the corpus,
    and the number of words and distinct words to learn from. Written to the shared folder.
    """
    sent = "block long, bucket int, keys binary, counts binary, terms binary, lengths binary, weights binary"
    names = [part.split()[0] for part in sent.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                number, texts, learnt = (batch.column(c)[at].as_py() for c in ("block", "texts", "learnt"))
                texts = _loose(texts).splitlines(keepends=True)
                rows = [(number, *row) for row in _bucket_rows(texts, np.array(learnt), buckets)]
                for start in range(0, len(rows), 64):
                    columns = zip(*rows[start : start + 64], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
                    )

    def merge(table: pa.Table) -> pa.Table:
        parts = table.sort_by("block").to_pydict()
        windows = [_risen(k) for k in parts["keys"]]
        counts = np.concatenate([_from_numbers(n) for n in parts["counts"]])
        keys, total = _summed(np.concatenate(windows), counts)
        number: dict[bytes, int] = {}
        words = []
        for blob, lengths in zip(parts["terms"], parts["lengths"], strict=True):
            blob, ends = _loose(blob), np.cumsum(_from_numbers(lengths)).tolist()
            own = [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            words.append(np.array([number.setdefault(term, len(number)) for term in own], np.int64))
        mass = np.zeros(len(number), np.int64)
        for place, weight in zip(words, parts["weights"], strict=True):
            mass[place] += _from_numbers(weight)
        places = [_rising(np.searchsorted(keys, own)) for own in windows]
        row = {
            "bucket": (parts["bucket"][0], pa.int32()),
            "keys": (_rising(keys), pa.binary()),
            "counts": (_numbers(total), pa.binary()),
            "blocks": (parts["block"], pa.list_(pa.int64())),
            "places": (places, pa.list_(pa.binary())),
            "words": ([_numbers(mass[own]) for own in words], pa.list_(pa.binary())),
            "used": (int((mass > 0).sum()), pa.int64()),
            "mass": (int(mass.sum()), pa.int64()),
        }
        return pa.table({name: pa.array([value], kind) for name, (value, kind) in row.items()})

    schema = (
        "bucket int, keys binary, counts binary, blocks array<long>, places array<binary>,"
        " words array<binary>, used long, mass long"
    )
    rows = packed.select("block", "texts", "learnt").mapInArrow(send, sent)
    return pin(rows.groupBy("bucket").applyInArrow(merge, schema), "windows")


def _bucket_rows(texts: list[bytes], learnt: np.ndarray, buckets: int) -> Iterator[tuple]:
    """(bucket, windows, their counts, words, their lengths, their counts) of a block."""
    keys, counts = listed(texts, learnt)
    of = _bucket(keys, buckets)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(buckets + 1))
    # Words in the order they come up, as the texts' own numbers of them are in ``score``.
    seen = Counter(chain.from_iterable(map(bytes.split, texts)))
    terms = list(seen)
    term_of, term_order = _by_bucket(terms, buckets)
    term_cuts = np.searchsorted(term_of[term_order], np.arange(buckets + 1))
    # Few texts are not learnt from.
    seen.subtract(chain.from_iterable(map(bytes.split, compress(texts, ~learnt))))
    for bucket in range(buckets):
        mine = order[cuts[bucket] : cuts[bucket + 1]]
        own = [terms[i] for i in term_order[term_cuts[bucket] : term_cuts[bucket + 1]].tolist()]
        if mine.size or own:
            lengths, weights = np.array([[len(t), seen[t]] for t in own], np.int64).reshape(-1, 2).T
            yield (
                bucket, _rising(keys[mine]), _numbers(counts[mine]), _tight(b"".join(own)), _numbers(lengths), _numbers(weights),
            )


def _context(keys: np.ndarray, order: int) -> np.ndarray:
    return keys >> np.uint64(8 * (ORDERS + 1 - order))


def _letters(keys: np.ndarray) -> np.ndarray:
    """Bytes of the current word before the one to come, up to ``ORDERS``."""
    out = np.full(keys.size, ORDERS)
    for back in range(ORDERS, 0, -1):
        byte = _context(keys, back) & np.uint64(255)
        out[(byte == 32) | (byte == 10)] = back - 1
    return out


def _slot(keys: np.ndarray, node: np.ndarray, order: int) -> np.ndarray:
    """Slot of a short context and the bits so far: one for each there can be."""
    return (_context(keys, order) << np.uint64(8)).astype(np.int64) | node


def _node(byte: np.ndarray, bit: int) -> np.ndarray:
    """The bits so far, behind a leading one."""
    return (1 << bit) | (byte >> (8 - bit))


def _codes(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte: exact up to 16, then eight steps for each doubling."""
    steps = np.rint(8 * np.log2(np.maximum(counts, 16) / 16)) + 16
    return np.where(counts <= 16, counts, np.minimum(steps, 255)).astype(np.uint8)


def _pair(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _codes(zeros).astype(np.uint16) << 8 | _codes(ones)


_DECODED = np.where(np.arange(256) <= 16, np.arange(256), 16 * 2 ** ((np.arange(256) - 16) / 8))


def _without(came: int) -> np.ndarray:
    """The codes of all slots, less one occurrence of a bit where its count is exact."""
    zeros, ones = np.arange(65536) >> 8, np.arange(65536) & 255
    own = ones if came else zeros
    own -= (own > 0) & (own <= 16)
    return zeros << 8 | ones


#: Codes of all slots: without an own zero, without an own one, whole.
_SEEN = np.concatenate([_without(0), _without(1), np.arange(65536)])
_ODDS = (np.log(_DECODED[_SEEN & 255] + PRIOR) - np.log(_DECODED[_SEEN >> 8] + PRIOR)).astype(np.float32)
_KNOWN = (_SEEN > 0).astype(np.int8)
_ORDER = np.arange(ORDERS + 1, dtype=np.int8)[:, None]


def count_tables(windows: DataFrame) -> list[np.ndarray]:
    """Counts of the contexts of at most ``SHARED`` bytes, as zeros << 8 | ones in one-byte codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts")), strict=True):
                keys, counts = _risen(k), _from_numbers(n)
                byte = (keys & np.uint64(255)).astype(np.int64)
                for order in range(SHARED + 1):
                    slots = np.concatenate(
                        [_slot(keys, _node(byte, bit), order) * 2 + (byte >> (7 - bit) & 1) for bit in range(8)]
                    )
                    slots, sums = _summed(slots, np.tile(counts, 8))
                    chunk = slots >> (_CHUNK_BITS + 1)
                    cuts = np.flatnonzero(np.diff(chunk)) + 1
                    for part in np.split(np.arange(slots.size), cuts):
                        if part.size:
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([order], pa.int32()),
                                    pa.array([int(chunk[part[0]])], pa.int32()),
                                    pa.array([planes(slots[part])], pa.binary()),
                                    pa.array([planes(sums[part], 8)], pa.binary()),
                                ],
                                ["context", "chunk", "slots", "sums"],
                            )

    width = 1 << (_CHUNK_BITS + 1)

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for slots, sums in zip(*(table.column(c).to_pylist() for c in ("slots", "sums")), strict=True):
            total[unplaned(slots) % width] += unplaned(sums, 8)
        return pa.table(
            {
                "context": table.column("context")[:1].cast(pa.int32()),
                "chunk": table.column("chunk")[:1].cast(pa.int32()),
                "codes": pa.array([_pair(total[0::2], total[1::2]).tobytes()], pa.binary()),
            }
        )

    rows = (
        windows.select("keys", "counts")
        .mapInArrow(run, "context int, chunk int, slots binary, sums binary")
        .groupBy("context", "chunk")
        .applyInArrow(merge, "context int, chunk int, codes binary")
        .collect()  # 2 bytes for each of at most 2 ** (8 * SHARED + 8) slots
    )
    tables = [np.zeros(max(1 << 8 * order + 8, 1 << _CHUNK_BITS), np.uint16) for order in range(SHARED + 1)]
    for row in rows:
        codes = np.frombuffer(row["codes"], np.uint16)
        at = row["chunk"] << _CHUNK_BITS
        tables[row["context"]][at : at + codes.size] = codes
    return tables


def long_counts(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Codes of the longer contexts of a bucket's windows, by (order, bit, window); exact, none shared."""
    out = np.empty((ORDERS - SHARED, 8, keys.size), np.uint16)
    byte = keys & np.uint64(255)
    for order in range(SHARED + 1, ORDERS + 1):
        value = (_context(keys, order) << np.uint64(8) | byte).astype(np.int64)
        by = np.argsort(value)
        value, n = value[by], counts[by]
        for bit in range(8):
            starts = _starts(value >> (8 - bit))
            ones = np.add.reduceat(n * (value >> (7 - bit) & 1), starts) if starts.size else starts
            both = np.add.reduceat(n, starts) if starts.size else starts
            sizes = np.diff(np.append(starts, value.size))
            out[order - SHARED - 1, bit, by] = np.repeat(_pair(both - ones, ones), sizes)
    return out


class Mixer:
    """Counts of short contexts, gated weights and the refining table."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        # Rows of the first gate, then those of the second.
        self.weights = np.full((2 * _GATES, ORDERS + 1), 0.05)
        for k in range(ORDERS + 1):
            own = slice(k * _NODES, (k + 1) * _NODES)
            self.weights[own, k] = 0.3
            # After j letters of a word, j + 1 bytes of context reach back to its start.
            self.weights[_GATES + own.start : _GATES + own.stop, min(k + 1, ORDERS)] = 0.3
        centre = np.linspace(-_REACH, _REACH, _BINS)
        # Zeros and ones seen after a prediction, with a little belief in the prediction.
        ones = 1 / (1 + np.exp(-centre))
        self.seen = np.stack([np.tile(1 - ones, (_NODES, 1)), np.tile(ones, (_NODES, 1))]) * 20

    def bit(self, keys: np.ndarray, letters: np.ndarray, longer: np.ndarray, bit: int, alone: bool):
        """Log odds per order, both gates, bits so far and the bit itself of every window.

        ``longer`` are the codes of its longer contexts; ``alone`` takes the window's own
        occurrence out of the counts.
        """
        byte = (keys & np.uint64(255)).astype(np.int64)
        node, came = _node(byte, bit), byte >> (7 - bit) & 1
        codes = np.empty((ORDERS + 1, keys.size), np.int32)
        for order in range(SHARED + 1):
            codes[order] = self.tables[order][_slot(keys, node, order)]
        codes[SHARED + 1 :] = longer[:, bit]
        codes += (came if alone else 2) << 16
        longest = (_KNOWN[codes] * _ORDER).max(0)
        return _ODDS[codes], (longest.astype(np.int64) * _NODES + node, _GATES + letters * _NODES + node), node, came

    def predict(self, odds: np.ndarray, gates: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        weights = self.weights[gates[0]] + self.weights[gates[1]]
        return np.clip(np.einsum("on,no->n", odds, weights), -_REACH * 2, _REACH * 2)

    @staticmethod
    def cell(mixed: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(mixed, -_REACH, _REACH) + _REACH) * ((_BINS - 1) / (2 * _REACH))).astype(int)

    def chance(self, mixed: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one, refined."""
        cell = self.cell(mixed)
        zeros, ones = self.seen[0][node, cell], self.seen[1][node, cell]
        refined = ones / (zeros + ones)
        return np.clip((1 / (1 + np.exp(-mixed)) + refined) / 2, _CERTAIN, 1 - _CERTAIN)

    def score(self, keys: np.ndarray, longer: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last byte after the others."""
        out = np.zeros(keys.size)
        for start in range(0, keys.size, _SCORED):
            part = slice(start, start + _SCORED)
            letters = _letters(keys[part])
            for bit in range(8):
                odds, gates, node, came = self.bit(keys[part], letters, longer[:, :, part], bit, alone=False)
                one = self.chance(self.predict(odds, gates), node)
                out[part] += np.log10(np.where(came == 1, one, 1 - one))
        return out

    def learn(self, keys: np.ndarray, counts: np.ndarray, longer: np.ndarray, rate: float) -> tuple:
        """One online pass over windows.

        Returns the occurrences by gate, and zeros and ones by (bits so far, cell).
        """
        shape = (2, ORDERS + 1, _NODES)
        weights = self.weights.reshape(*shape, ORDERS + 1)
        state = np.full(weights.shape, 1e-8)
        seen, visits = np.zeros(self.seen.size), np.zeros(shape)
        for start in range(0, keys.size, _STEP):
            step = slice(start, start + _STEP)
            n, letters = counts[step].astype(np.float64), _letters(keys[step])
            for bit in range(8):
                odds, gates, node, came = self.bit(keys[step], letters, longer[:, :, step], bit, alone=True)
                mixed = self.predict(odds, gates)
                error = (came - 1 / (1 + np.exp(-mixed))) * n / n.sum()
                slopes = (error * odds).T.ravel()
                # Of each gate's nodes, those with as many bits so far.
                nodes = 1 << bit
                for half, gate in enumerate(gates):
                    own = (gate - half * _GATES) // _NODES * nodes + node - nodes
                    size = (ORDERS + 1) * nodes
                    visits[half, :, nodes : 2 * nodes] += np.bincount(own, n, size).reshape(-1, nodes)
                    places = (own[:, None] * (ORDERS + 1) + np.arange(ORDERS + 1)).ravel()
                    slope = np.bincount(places, slopes, size * (ORDERS + 1)).reshape(-1, nodes, ORDERS + 1)
                    held = state[half, :, nodes : 2 * nodes]
                    held += slope * slope
                    weights[half, :, nodes : 2 * nodes] += rate * slope / np.sqrt(held)
                cells = (came * _NODES + node) * _BINS + self.cell(mixed)
                seen += np.bincount(cells, n, seen.size)
        return visits.ravel(), seen.reshape(self.seen.shape)


def learn(windows: DataFrame, tables: list[np.ndarray]) -> Mixer:
    """Weights learnt bucket by bucket side by side and averaged, round after round."""
    shared = windows.sparkSession.sparkContext.broadcast(tables)
    mixer = Mixer(tables)
    for number in range(ROUNDS):
        weights, rate = mixer.weights, RATE / (1 + number)

        def run(batches, weights=weights, rate=rate) -> Iterator[pa.RecordBatch]:
            values = np.zeros(weights.size + 2 * _GATES + mixer_cells)
            for batch in batches:
                for k, n in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts")), strict=True):
                    keys, counts = _risen(k), _from_numbers(n)
                    keys, counts = keys[counts > 0], counts[counts > 0]
                    # Neighbours in key order are alike: a fixed shuffle mixes them.
                    order = np.argsort(_mixed(keys))
                    own = Mixer(shared.value)
                    own.weights = weights.copy()
                    longer = long_counts(keys, counts)[:, :, order]
                    visits, seen = own.learn(keys[order], counts[order], longer, rate)
                    # Rounded, so that sums do not depend on their order.
                    weighed = np.rint(own.weights * visits[:, None] * _EXACT) / _EXACT
                    values += np.concatenate([weighed.ravel(), visits, seen.ravel()])
            some = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(values[some])], ["place", "value"])

        mixer_cells = mixer.seen.size
        rows = (
            windows.select("keys", "counts")
            .mapInArrow(run, "place long, value double")
            .groupBy("place")
            .agg(F.sum("value").alias("value"))
            .collect()  # one number per weight and cell
        )
        values = np.zeros(weights.size + 2 * _GATES + mixer_cells)
        for place, value in rows:
            values[place] = value
        sums, visits, seen = np.split(values, [weights.size, weights.size + 2 * _GATES])
        # A gate's weights count by how often a bucket came to it.
        mean = sums.reshape(weights.shape) / np.maximum(visits, 1)[:, None]
        mixer.weights = np.where(visits[:, None] > 0, mean, weights)
    shared.unpersist()
    mixer.seen = Mixer(tables).seen + seen.reshape(mixer.seen.shape)
    return mixer


def judged(windows: DataFrame, mixer: Mixer) -> DataFrame:
    """(block, bucket, keys, scores, words): each block's windows with their scores, in whole steps below
    zero, and the corpus counts of its words. A window is scored once, whatever number of blocks hold it.
    """
    shared = windows.sparkSession.sparkContext.broadcast((mixer.tables, mixer.weights, mixer.seen))
    names, types = ["block", "bucket", "keys", "scores", "words"], [pa.int64(), pa.int32(), *[pa.binary()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in ("bucket", "keys", "counts", "blocks", "places", "words")}
                keys, counts = _risen(row["keys"]), _from_numbers(row["counts"])
                own = Mixer(shared.value[0])
                _, own.weights, own.seen = shared.value
                steps = np.rint(own.score(keys, long_counts(keys, counts)) * -_UNIT).astype(np.int64)
                out = []
                for block, places, words in zip(row["blocks"], row["places"], row["words"], strict=True):
                    place = _risen(places)
                    out.append((block, row["bucket"], _rising(keys[place]), _numbers(steps[place]), words))
                for start in range(0, len(out), 64):
                    columns = zip(*out[start : start + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return windows.select("bucket", "keys", "counts", "blocks", "places", "words").mapInArrow(
        run, "block long, bucket int, keys binary, scores binary, words binary"
    )


class Lookup:
    """Scores of a block's windows: one place per hash, another for those that lost it, and a search for the rest."""

    def __init__(self, keys: np.ndarray, steps: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.steps = keys[order], steps[order]
        self.first = self._places(np.arange(keys.size), _SPREAD, _PLACE_BITS)
        lost = np.flatnonzero(self.first[self._at(self.keys, _SPREAD, _PLACE_BITS)] != np.arange(keys.size))
        self.second = self._places(lost, _SECOND, _SECOND_BITS)

    def _places(self, own: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
        place = np.zeros(1 << bits, np.int32)
        place[self._at(self.keys[own], factor, bits)] = own
        return place

    @staticmethod
    def _at(keys: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
        at = keys * factor
        at >>= np.uint64(64 - bits)
        return at.view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        found = self.first[self._at(keys, _SPREAD, _PLACE_BITS)]
        lost = np.flatnonzero(self.keys[found] != keys)
        own = keys[lost]
        found[lost] = again = self.second[self._at(own, _SECOND, _SECOND_BITS)]
        rest = np.flatnonzero(self.keys[again] != own)
        found[lost[rest]] = np.searchsorted(self.keys, own[rest])
        return self.steps[found]


@lru_cache(maxsize=1 << 16)
def remainder(doc_id: int | None) -> int:
    """crc32 of the id as text modulo 7; -1 without an id."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    ``bits_per_byte`` is the score over the bytes of the text as the model reads it.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    packed = pack(rows.withColumn("learnt", F.coalesce(fold != 2, F.lit(False))))
    size = packed.agg(F.sum("bytes").alias("bytes"), F.sum("ends").alias("ends")).first()
    buckets = max(_BUCKETS, -(-(size["bytes"] or 0) // BUCKET_BYTES))
    windows = bucketed(packed, buckets)
    values = judged(windows, learn(windows, count_tables(windows)))
    totals = windows.agg(F.sum("used").alias("used"), F.sum("mass").alias("mass")).first()
    ends = size["ends"] or 0
    train_tokens = (totals["mass"] or 0) + ends
    distinct = (totals["used"] or 0) + (ends > 0)
    whole, end = np.log10(train_tokens + distinct + 1.0), np.log10(ends + 1.0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, texts = (left.column(c)[0].as_py() for c in ("doc_ids", "texts"))
        texts = _loose(texts).splitlines(keepends=True)
        parts = right.sort_by("bucket").to_pydict()
        lookup = Lookup(
            np.concatenate([_risen(k) for k in parts["keys"]]),
            np.concatenate([_from_numbers(s) for s in parts["scores"]]),
        )
        steps = np.zeros(len(texts))
        for keys, owner in window_parts(texts):
            steps += np.bincount(owner, lookup.of(keys), len(texts))
        # Words are numbered as they come up.
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        words = [list(map(number.__getitem__, text.split())) for text in texts]
        counts = np.zeros(len(number), np.int64)
        counts[_by_bucket(list(number), buckets)[1]] = np.concatenate([_from_numbers(w) for w in parts["words"]])
        logs, known = np.log10(counts + 1.0), counts > 0
        base, n_tokens, n_known = np.empty((3, len(texts)))
        for i, own in enumerate(words):
            at = np.array(own, np.int64)
            n_tokens[i] = at.size + 1
            n_known[i] = known[at].sum() + (ends > 0)
            base[i] = logs[at].sum() + end - n_tokens[i] * whole
        total = steps / -_UNIT
        sizes = np.array([len(text) for text in texts])
        return pa.table(
            {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "held_out": pa.array([remainder(i) == 2 for i in doc_ids], pa.bool_()),
                "n_tokens": pa.array(n_tokens.astype(np.int64)),
                "n_known": pa.array(n_known.astype(np.int64)),
                "train_tokens": pa.array([train_tokens] * len(texts), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(total, pa.float64()),
                "bits_per_byte": pa.array(total * -np.log2(10) / sizes, pa.float64()),
            }
        )

    return (
        packed.select("block", "doc_ids", "texts")
        .groupBy("block")
        .cogroup(values.groupBy("block"))
        .applyInArrow(
            run,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
            " base_score double, score double, bits_per_byte double",
        )
    )
