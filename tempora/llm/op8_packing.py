"""Lexical retrieval packing.

Documents are tokenised once, where they lie, and dealt to shards of bounded size by their topic: the rarest of a
document's tokens that two of 4096 documents share, by the counts of all documents. Topics of more tokens than a part of a
shard are dealt in parts. Each shard has
a BM25 inverted index over token ids. A seed document opens a window; its unused neighbours fill it in the order of their scores; the one that
does not fit is cut, and its rest opens the next window as its seed. So every window is full, and what is left of a
shard at its end goes into sequences of 2048, 1024, ... tokens, which need no padding.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, blocks, checkpointed, mix, released, spread, table, to_binary

WINDOW, END_ID = 4096, 2
#: Tokens in a shard, about.
SHARD = 1 << 20
K1, B = 1.2, 0.75
#: A topic stands in two documents at least, and in two of so many.
TOPIC_RARE = 4096
#: Parts of a topic in a shard, about.
TOPIC_PARTS = 4
#: Terms in more than this share of a shard's documents are kept as rows of a table instead of postings.
COMMON = 0.25
#: Distinct words whose ids a worker keeps at most; then it starts anew.
KEPT_WORDS = 400_000

_KIND = np.zeros(256, np.uint8)  # 0 white space, 1 letter, 2 other ASCII, 3 anything else
_KIND[:] = 3
_KIND[33:127] = 2
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
_KIND[list(b"'0123456789")] = 3
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: What a vocabulary file says of its normaliser and its words, for which stretches can be encoded on their own (fixed values).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: After the words: letters of ASCII stand for themselves, so the model alone has the ids of a stretch of them.
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def default_tokenizer() -> str:
    """The installed vocabulary file; any file of the same library serves."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts.

    With the known normaliser and words, tokens cross neither white space nor the border of ASCII letters and signs
    (apostrophes and digits aside), so each stretch between such borders is encoded once; one of ASCII letters alone is
    left by normaliser and splitter as it is in lower case, so it goes to the model at once. Texts that hold an added token
    of the vocabulary, and all texts under another vocabulary, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.stretches = (told.get("normalizer") or {}).get("normalizers") == NORMALIZERS and (steps[0].get("pattern") or {}).get("Regex") == WORDS
        self.added = [t["content"].encode() for t in told.get("added_tokens") or []]
        self.stretches &= not any(t.get("normalized") for t in told.get("added_tokens") or [])
        self.plain = self.stretches and steps[1:] == [BYTES] and (told.get("model") or {}).get("type") == "BPE"
        self.model = self.tokenizer.model
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.forget()

    def forget(self) -> None:
        """No stretches are known: their bytes, where the ids of each begin, and all ids."""
        self.known, self.begin, self.ids = pa.array([], pa.binary()), np.zeros(1, np.int64), np.zeros(0, self.type)

    def _learn(self, words: pa.Array) -> None:
        told = words.to_pylist()
        found: list[list[int]] = [[]] * len(told)
        rest = []
        for k, w in enumerate(told):
            if self.plain and w.isalpha():  # of ASCII letters
                found[k] = [t.id for t in self.model.tokenize(w.decode())]
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([told[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
            found[k] = e.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.known = pa.concat_arrays([self.known, words])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), self.type, int(size.sum()))])

    def places(self, words: pa.Array) -> np.ndarray:
        """Which of the known stretches each of some distinct ones is; new ones become known."""
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy()
        new = at < 0
        if new.any():
            n = len(self.known)
            if n and n + int(new.sum()) > KEPT_WORDS:
                self.forget()
                return self.places(words)
            self._learn(words.filter(pa.array(new)))
            at = np.where(new, n + np.cumsum(new) - 1, at)
        return at

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts are to be encoded whole."""
        out, flat = np.full(len(offsets) - 1, not self.stretches), data.tobytes() if self.stretches else b""
        for token in self.added if self.stretches else ():
            at = flat.find(token)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                out[k] |= at + len(token) <= offsets[k + 1]
                at = flat.find(token, int(offsets[k + 1]) if out[k] else at + 1)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by the end id, and how many each has."""
        n, given = len(offsets) - 1, data
        whole = np.flatnonzero(self.whole(data, offsets))
        if len(whole):  # no stretches in those
            data = data.copy()
            data[spread(offsets[whole], offsets[whole + 1] - offsets[whole])] = 0x20
        kind = _KIND[data]
        border = np.zeros(len(data), bool)
        a, b = kind[:-1], kind[1:]
        border[1:] = (a != b) & ((a == 0) | (b == 0) | ((a != 3) & (b != 3)))
        border[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(border)
        size = np.diff(np.append(start, len(data)))
        word = kind[start] > 0
        start, size = start[word], size[word]
        of = np.searchsorted(start, offsets)
        coded = to_binary(_LOWER[data[spread(start, size)]], np.concatenate([[0], np.cumsum(size)])).dictionary_encode()
        code = self.places(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        flat, begin, long = self.ids, self.begin, np.diff(self.begin)
        per_text = np.diff(np.concatenate([[0], np.cumsum(long[code])])[of]) if len(code) else np.zeros(n, np.int64)
        texts = [given[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in whole]
        full = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.type) for t in texts]
        total = per_text + 1
        total[whole] += np.fromiter(map(len, full), np.int64, len(full))
        out = np.full(int(total.sum()), END_ID, self.type)
        start = np.cumsum(total) - total
        out[spread(start, per_text)] = flat[spread(begin[code], long[code])]
        for k, ids in zip(whole.tolist(), full, strict=True):
            out[start[k] : start[k] + len(ids)] = ids
        return out, total


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a vocabulary file, which a worker loads once."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Topics:
    """For each token its worth as a topic, and for topics that many documents share the number of parts; bounded by the vocabulary."""

    def __init__(self, size: int = 0, type_: np.dtype | None = None):
        self.type = type_  # of the ids
        self.worth = np.zeros(size, np.uint64)  # rarer tokens first, by hash among equals; 0 for no topic
        self.parts: dict[int, int] = {}

    def of(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The topic of each document, whose ids begin at ``start``."""
        if not len(self.worth):
            return np.zeros(len(start), np.int64)
        return np.maximum.reduceat(self.worth[ids], start).view(np.int64)

    def part(self, topic: int, name: int) -> int:
        return name % self.parts.get(topic, 1)


def _encoded(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            for part, data, offsets in blocks(batch, "text", 1 << 22):
                ids, n = encoder.encode(data, offsets)
                yield pa.record_batch({"doc_id": part.column(0), "ids": to_binary(ids.view(np.uint8), np.concatenate([[0], np.cumsum(n)]) * ids.itemsize)})

    return run


def _ids(batch: pa.RecordBatch, type_: np.dtype) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of documents, their ids and where each one's begin; each has one id at least, its end."""
    for part, data, edge in blocks(batch, "ids", 1 << 21):
        yield part, np.ascontiguousarray(data).view(type_), (edge - edge[0]) // type_.itemsize


def _dealt(topics: Topics) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, edge in _ids(batch, topics.type):
                topic, packed = topics.of(ids, edge[:-1]), part.column(1)
                names = mix(part.column(0).fill_null(-1).to_numpy().astype(np.uint64) ^ np.fromiter((zlib.crc32(x.as_buffer()) for x in packed), np.uint64, len(packed)))
                shares = [topics.part(t, u) for t, u in zip(topic.tolist(), names.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": part.column(0), "ids": packed, "topic": pa.array(topic), "part": pa.array(shares, pa.int64())})

    return run


def _document_counts(type_: np.dtype, size: int) -> Callable:
    """In how many documents of a task each token of a vocabulary stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            for _, ids, edge in _ids(batch, type_):
                pair = np.sort(np.repeat(np.arange(len(edge) - 1, dtype=np.int64), np.diff(edge)) << 32 | ids)
                first = np.ones(len(pair), bool)
                first[1:] = pair[1:] != pair[:-1]
                n += np.bincount(pair[first] & 0xFFFFFFFF, minlength=size)
        token = np.flatnonzero(n)
        yield pa.record_batch({"token": pa.array(token), "n": pa.array(n[token])})

    return run


def _topic_sizes(topics: Topics) -> Callable:
    """The tokens of each topic's documents in a block of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, edge in _ids(batch, topics.type):
                topic, at = np.unique(topics.of(ids, edge[:-1]), return_inverse=True)
                yield pa.record_batch({"topic": pa.array(topic), "n": pa.array(np.bincount(at, np.diff(edge)).astype(np.int64))})

    return run


def counted_topics(ids: DataFrame, size: int, type_: np.dtype, part: int) -> Topics:
    """Topics from the counts of all documents (column ids) over a vocabulary of ``size`` tokens, in parts of about ``part`` tokens."""
    topics, ids = Topics(size, type_), ids.select(F.lit(None).cast("long").alias("doc_id"), "ids")
    least = max(2, -(-2 * ids.count() // TOPIC_RARE))
    counts = ids.mapInArrow(released(_document_counts(type_, size)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()
    for r in counts:  # at most one row for each token of the vocabulary
        topics.worth[r["token"]] = ((1 << 31) - 1 - min(r["n"], 1 << 30)) << 32 | r["token"]
    many = ids.mapInArrow(released(_topic_sizes(topics)), "topic long, n long").groupBy("topic").agg(F.sum("n").alias("n")).filter(F.col("n") > part).collect()
    topics.parts = {r["topic"]: -(-r["n"] // part) for r in many}
    return topics


class Index:
    """BM25 over the documents of a shard; terms of a large share of them are rows of a table, the others postings."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        n = len(size)
        doc = np.repeat(np.arange(n, dtype=np.int64), size)
        pair, tf = np.unique(doc << 32 | ids, return_counts=True)
        self.doc, term = pair >> 32, pair & 0xFFFFFFFF
        names, self.term, df = np.unique(term, return_inverse=True, return_counts=True)
        # this form of the weight is above 0 for every term
        weight = np.log1p((n - df + 0.5) / (df + 0.5))[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / size.mean()))
        common = df > COMMON * n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        dense = common[self.term]
        self.table = np.zeros((int(common.sum()), n))
        self.table[self.row[self.term[dense]], self.doc[dense]] = weight[dense]
        use = ~dense
        order = np.flatnonzero(use)[np.argsort(self.term[use], kind="stable")]
        self.posting, self.weight = self.doc[order], weight[order]
        self.edge = np.searchsorted(self.term[order], np.arange(len(names) + 1))
        self.of = np.searchsorted(self.doc, np.arange(n + 1))
        self.n = n

    def neighbours(self, seed: int, used: np.ndarray | None = None) -> np.ndarray:
        """All documents that share a term with the seed and are not ``used``, the best first, of equal ones the first."""
        terms = self.term[self.of[seed] : self.of[seed + 1]]
        at = spread(self.edge[terms], self.edge[terms + 1] - self.edge[terms])
        rows = self.row[terms]
        named = np.zeros(len(self.table))
        named[rows[rows >= 0]] = 1
        score = np.bincount(self.posting[at], self.weight[at], minlength=self.n) + named @ self.table
        found = np.flatnonzero(score > 0 if used is None else (score > 0) & ~used)
        return found[np.argsort(-score[found], kind="stable")]


def fill(size: np.ndarray, neighbours: Callable[[int, np.ndarray], np.ndarray], window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; all documents, in sequences that need no padding."""
    pieces, used = [], np.zeros(len(size), bool)
    sequence = offset = 0

    def place(doc: int) -> bool:
        """Whether the document ran into a further window, whose seed it then is."""
        nonlocal sequence, offset
        used[doc] = True
        start, total, opened = 0, int(size[doc]), False
        while start < total:
            take = min(total - start, window - offset)
            pieces.append((doc, start, take, sequence, offset))
            start, offset = start + take, offset + take
            if offset == window:
                sequence, offset, opened = sequence + 1, 0, start < total
        return opened

    for first in range(len(size)):
        seed = -1 if used[first] else first
        if seed >= 0:
            place(seed)
        while seed >= 0 and offset:
            again = -1
            for doc in neighbours(seed, used).tolist():
                if not used[doc]:
                    if place(doc):
                        again = doc
                        break
                    if not offset:
                        break
            seed = again
    if offset:  # the rest: powers of two
        last = [p for p in pieces if p[3] == sequence]
        del pieces[len(pieces) - len(last) :]
        rest, at = offset, 0
        for doc, start, length, _, _ in last:
            while length:
                room = 1 << (rest.bit_length() - 1)
                take = min(length, room - at)
                pieces.append((doc, start, take, sequence, at))
                start, length, at = start + take, length - take, at + take
                if at == room:
                    sequence, rest, at = sequence + 1, rest - room, 0
    return pieces


def _packed(type_: np.dtype, window: int, shard: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 36

        def pack(held):
            nonlocal done
            t = pa.Table.from_batches(held).combine_chunks()
            data, edge = binary(t.column("ids").chunk(0))
            ids, edge = np.ascontiguousarray(data).view(type_), edge // type_.itemsize
            size = np.diff(edge)
            pieces = np.array(fill(size, Index(ids.astype(np.int64), size).neighbours, window), np.int64).reshape(-1, 5)
            doc, start, length, sequence, offset = pieces.T
            out = ids[spread(edge[doc] + start, length)].astype("<u4")
            sequence = sequence + done
            done = int(sequence.max()) + 1
            number = lambda x: pa.array(np.ascontiguousarray(x))
            return pa.record_batch({
                "doc_id": t.column("doc_id").take(number(doc)).combine_chunks(), "start": number(start), "length": number(length), "doc_tokens": number(size[doc]),
                "sequence_id": number(base + sequence), "offset": number(offset), "ids": to_binary(out.view(np.uint8), np.concatenate([[0], np.cumsum(length)]) * 4),
            })

        held, tokens = [], 0
        for batch in batches:
            at = 0
            edge = binary(batch.column(1))[1] // type_.itemsize
            while at < len(batch):
                to = min(len(batch), max(at + 1, int(np.searchsorted(edge, edge[at] + shard - tokens, "right")) - 1))
                held.append(batch.slice(at, to - at))
                tokens += int(edge[to] - edge[at])
                at = to
                if tokens >= shard or at < len(batch):
                    yield pack(held)
                    held, tokens = [], 0
        if held:
            yield pack(held)

    return run


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32 bits) of each piece.

    Every row is packed on its own, rows that repeat an id too; a null or empty text is the end id alone; a null id
    stays null. ``window`` is a power of two. Sequences are full, or of a smaller power of two at the end of a shard.
    Added tokens of the vocabulary count as such in texts too, as the vocabulary has it; bytes that are not UTF-8 are
    U+FFFD. Other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    ready = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    encoder = encoder_of(path)
    ids = checkpointed(ready.mapInArrow(released(_encoded(path)), "doc_id long, ids binary"))
    topics = counted_topics(ids, encoder.tokenizer.get_vocab_size(), encoder.type, max(1, shard // TOPIC_PARTS))
    ids = ids.mapInArrow(released(_dealt(topics)), "doc_id long, ids binary, topic long, part long")
    # topics stay together as far as the size of a partition allows: Spark parts those that are larger, whatever the topic
    dealt = ids.hint("rebalance", F.col("topic"), F.col("part")).sortWithinPartitions("topic", "part", "doc_id", "ids").select("doc_id", "ids")
    return dealt.mapInArrow(released(_packed(topics.type, window, shard)), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
