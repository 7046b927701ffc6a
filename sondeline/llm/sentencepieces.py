"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model's protobuf is parsed here, and a tokenizers pipeline of the same behaviour is built from it: normaliser, metaspace
marker, unigram scores or byte-pair merges (rebuilt from the scores), byte fallback and decoder. Batches are encoded by
several threads. Where no piece goes on over a space, no merge does, and a text's ids are those of its words, put together in turn: each distinct
word is encoded once a task (as long as WORDS of them are remembered); other models encode whole texts. Parity with the sentencepiece library
is verified for every text when asked for: the text's own ids are compared with those of that library, which encodes words or whole texts by itself.

Long texts are encoded in parts that begin at a single space, where the model has no piece that goes on over a space; the
parts' ids together are then those of the whole text, and memory doesn't grow with a text's length.

Defined results: a null or empty text has no ids, decodes to an empty text, and counts as a round trip; a text that holds
the marker U+2581 itself decodes to one with spaces, so round_trip is false; strings of control pieces such as <s> are
ordinary text; repeated rows are encoded alike; an empty table gives no rows; other columns pass.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

# Fixed values of the public sentencepiece_model.proto.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARKER = "▁"

MODEL_BYTES = 64 << 20  #: a larger model isn't broadcast but refused
THREADS, GROUP_CHARS, PART_CHARS, WORDS, RUN = 2, 1 << 19, 1 << 16, 200_000, 1000
IDS = T.ArrayType(T.IntegerType())


def default_model() -> str:
    """The public vocabulary's path, where the package that holds it is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes):
    """(number, value) of each field of a protobuf message: an int, or bytes of a fixed or delimited field."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, raw[at : at + size]
        at += size


@dataclass
class Model:
    """What encoding and decoding need of a SentencePiece model file."""

    raw: bytes
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  #: text, score and type, by id
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    single_spaces: bool = True
    escaped: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        found = cls(raw)
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                found.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(_fields(value))
                found.kind, found.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                if spec.get(24, 0):
                    raise ValueError("models with the space marker at word ends aren't supported")
            elif number == 3:
                spec = dict(_fields(value))
                found.charsmap = spec.get(2, b"")
                found.dummy_prefix, found.single_spaces, found.escaped = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        if found.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if any(t == USER_DEFINED for _, _, t in found.pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        return found

    @property
    def splits_at_spaces(self) -> bool:
        """Whether a text may be cut before a space: no piece goes on over one, and the parts' dummy prefix stands for it."""
        over = re.compile(f"[^{MARKER}]{MARKER}")
        return self.dummy_prefix and self.escaped and not self.charsmap and not any(over.search(p) for p, _, _ in self.pieces)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs in the order in which SentencePiece joins them: by the joined piece's score, then its id."""
        place = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, UNUSED)}
        found = []
        for whole, i in place.items():
            pairs = [(whole[:k], whole[k:]) for k in range(1, len(whole))]
            found += [(-self.pieces[i][1], i, place[a], place[b], (a, b)) for a, b in pairs if a in place and b in place]
        return [pair for *_, pair in sorted(found)]

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), None)
        if self.kind == BPE:
            vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(
                vocabulary, self.merges(), unk_token=None if unknown is None else self.pieces[unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback, cache_capacity=0
            )
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=unknown, byte_fallback=self.byte_fallback)
        made = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.single_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARKER if self.escaped else " "))
        if self.escaped:
            steps.append(normalizers.Replace(" ", MARKER))
        if steps:
            made.normalizer = normalizers.Sequence(steps)
        back = [decoders.ByteFallback(), decoders.Metaspace(MARKER, "never", False), decoders.Fuse()]
        made.decoder = decoders.Sequence([*back, *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return made


class Codec:
    """One task's tokenizer and, for parity, the sentencepiece processor."""

    def __init__(self, raw: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model, self.threads = Model.parse(raw), threads
        self.tokenizer = self.model.tokenizer()
        self.cut = self.model.splits_at_spaces and not self.model.single_spaces
        self.place = re.compile(f"(?<=[^ {MARKER}]) (?=[^ {MARKER}])")
        self._reference = None
        self.word = re.compile(" +[^ ]*")
        self.worded = self.cut and self.model.kind == BPE and any(p == MARKER and t == NORMAL for p, _, t in self.model.pieces)
        begins = np.array([p.startswith(MARKER) for p, _, _ in self.model.pieces])
        self.numbers = Numbers()
        self.made_of, self.ids_of = WordIds(self._own, begins), WordIds(lambda words: self.reference(words), begins)  #: own ids of words(), and sentencepiece's

    def parts(self, text: str) -> list[str]:
        if not self.cut or len(text) <= PART_CHARS:
            return [text]
        out, done = [], 0
        while len(text) - done > PART_CHARS and (found := self.place.search(text, done + PART_CHARS)):
            out.append(text[done : found.start()])
            done = found.end()  # the part's dummy prefix stands for the space
        return [*out, text[done:]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self.encoded(texts)]

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids as int32. Where the model allows it, each distinct word is encoded once, as long as WORDS of them are remembered."""
        if self.worded:
            return self._by_words(texts, self.made_of)[0]
        return [np.array(ids, np.int32) for ids in self._joined(texts, self._own)]

    def checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """encoded() and its parity()."""
        if self.worded:
            own, right = self._by_words(texts, self.made_of, self.ids_of)
            return own, [np.array_equal(x, y) for x, y in zip(own, right, strict=True)]
        own = self.encoded(texts)
        return own, self.parity(texts, own)

    def _own(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def reference(self, texts: list[str]) -> list[list[int]]:
        """The sentencepiece library's ids."""
        if self._reference is None:
            import sentencepiece

            self._reference = sentencepiece.SentencePieceProcessor(model_proto=self.model.raw)
        return self._joined(texts, lambda parts: self._reference.encode(parts, num_threads=self.threads))

    def referenced(self, texts: list[str]) -> list[np.ndarray]:
        """reference() as arrays; where the model allows it, the library encodes each distinct word once, as long as WORDS of them are remembered."""
        if self.worded:
            return self._by_words(texts, self.ids_of)[0]
        return [np.array(ids, np.int32) for ids in self.reference(texts)]

    def parity(self, texts: list[str], ids) -> list[bool]:
        """Whether each text's ids are the sentencepiece library's."""
        right = self._by_words(texts, self.ids_of)[0] if self.cut else self.reference(texts)
        return [np.array_equal(x, y) for x, y in zip(right, ids, strict=True)]

    def words(self, text: str) -> list[str]:
        """Words, each without the space (or dummy prefix) before it, but with any further ones."""
        text = text.replace(MARKER, " ")
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in self.word.findall(" " + text)]
        return text.split(" ")

    def _by_words(self, texts: list[str], *tables: WordIds) -> list[list[np.ndarray]]:
        """Each text's ids in each table, put together from those of its words."""
        parts = [self.parts(t) for t in texts]
        every = list(chain.from_iterable(parts))
        found: list[list[np.ndarray]] = [[] for _ in tables]
        for a, b in _groups(every):
            if len(self.numbers) > WORDS:
                for known in (self.numbers, self.made_of, self.ids_of):
                    known.clear()
            words = [self.words(t) for t in every[a:b]]
            sizes = [len(w) for w in words]
            numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
            for table, out in zip(tables, found, strict=True):
                table.learn(list(islice(self.numbers, len(table.first), None)))
                out += table.of(numbers, sizes)
        return [_glued(out, parts) for out in found]

    def _joined(self, texts, encode) -> list[list[int]]:
        parts = [self.parts(t) for t in texts]
        every = list(chain.from_iterable(parts))
        flat = (ids for a, b in _groups(every) for ids in encode(every[a:b]))  # the library's own records of a long text don't add up
        return [next(flat) if len(p) == 1 else list(chain.from_iterable(next(flat) for _ in p)) for p in parts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


class Numbers(dict):
    """Each word's number, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found


class WordIds:
    """Ids of numbered words, in one array."""

    def __init__(self, encode, begins: np.ndarray):
        self.encode, self.begins = encode, begins  #: begins: by id, whether the piece begins with the marker
        self.clear()

    def clear(self) -> None:
        self.ids, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        """Add words. Those without a space are encoded a RUN at a time, for a word's first piece begins with the marker, and no other piece does."""
        first, size, made, done = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [self.ids], len(self.ids)
        plain = [k for k, w in enumerate(words) if w and " " not in w]
        alone = [k for k, w in enumerate(words) if not w or " " in w]
        runs = [plain[k : k + RUN] for k in range(0, len(plain), RUN)]
        for run, ids in zip(runs, self.encode([" ".join([words[k] for k in run]) for run in runs]), strict=True):
            ids = np.array(ids, np.int32)
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(run) or at[0]:  # not so: word by word
                alone += run
                continue
            first[run], size[run] = done + at, np.diff(at, append=len(ids))
            made.append(ids)
            done += len(ids)
        if alone:  # the dummy prefix stands for the space before, and spaces alone stand after a letter
            bare = [not words[k].strip(" ") for k in alone]
            letter, *found = self.encode(["a", *("a " + words[k] if b else words[k] for k, b in zip(alone, bare, strict=True))])
            for k, b, ids in zip(alone, bare, found, strict=True):
                made.append(np.array(ids[len(letter) if b else 0 :], np.int32))
                first[k], size[k] = done, len(made[-1])
                done += len(made[-1])
        self.ids, self.first, self.size = np.concatenate(made), np.concatenate([self.first, first]), np.concatenate([self.size, size])

    def of(self, numbers: np.ndarray, words: list[int]) -> list[np.ndarray]:
        """Ids of texts that have so many words each."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        at = np.repeat(self.first[numbers] - ends + size, size)
        at += np.arange(len(at))
        cuts = np.concatenate([[0], ends])[np.cumsum(words)]
        return np.split(self.ids[at], cuts[:-1]) if words else []


def _glued(found: list[np.ndarray], parts: list[list[str]]) -> list[np.ndarray]:
    flat = iter(found)
    return [next(flat) if len(p) == 1 else np.concatenate(list(islice(flat, len(p)))) for p in parts]


def _groups(texts: list[str]):
    """Slices of a bounded number of characters, or of one text."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > GROUP_CHARS:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def _shipped(spark: SparkSession, model: str | bytes | None):
    raw = model if isinstance(model, bytes) else open(model or default_model(), "rb").read()
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"a model of more than {MODEL_BYTES} bytes isn't broadcast")
    return spark.sparkContext.broadcast(raw)


def encode(docs: DataFrame, model: str | bytes | None = None, text: str = "text", keep_text: bool = True, verify: bool = False, threads: int = THREADS) -> DataFrame:
    """Add token_ids and n_tokens; with verify also round_trip (decoding gives the text) and parity (sentencepiece gives the same ids)."""
    sent = _shipped(docs.sparkSession, model)

    def make():
        codec = Codec(sent.value, threads)

        def work(column: pa.Array) -> list[pa.Array]:
            texts = [t or "" for t in column.to_pylist()]
            flat, sizes, back, same = [np.zeros(0, np.int32)], [0], [], []
            for a, b in _groups(texts):
                ids, right = codec.checked(texts[a:b]) if verify else (codec.encoded(texts[a:b]), [])
                sizes += map(len, ids)
                flat += ids
                same += right
                if verify:
                    back += [x == y for x, y in zip(codec.decode([x.tolist() for x in ids]), texts[a:b], strict=True)]
            made = [pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(flat))), pa.array(sizes[1:], pa.int64())]
            return made + ([pa.array(back, pa.bool_()), pa.array(same, pa.bool_())] if verify else [])

        return work

    fields = [T.StructField("token_ids", IDS), T.StructField("n_tokens", T.LongType())]
    if verify:
        fields += [T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())]
    return append_columns(docs, text, fields, make, drop=() if keep_text else (text,))


def decode(encoded: DataFrame, model: str | bytes | None = None, ids: str = "token_ids", out: str = "text", threads: int = THREADS) -> DataFrame:
    """Add the text of the ids. Null ids give an empty text; null elements and ids beyond the vocabulary are left out."""
    sent = _shipped(encoded.sparkSession, model)

    def make():
        codec = Codec(sent.value, threads)
        count = len(codec.model.pieces)

        def work(column: pa.Array) -> list[pa.Array]:
            rows = [[i for i in row or () if i is not None and 0 <= i < count] for row in column.to_pylist()]
            return [pa.array(codec.decode(rows), pa.string())]

        return work

    return append_columns(encoded, ids, [T.StructField(out, T.StringType())], make)


def encode_documents(docs: DataFrame, model: str | bytes | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip, parity) of every row."""
    found = encode(docs.select(doc_id, F.col(text)), model, text, keep_text=False, verify=True)
    return found.select(doc_id, "token_ids", "n_tokens", "round_trip", "parity")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return encode_documents(table(spark, sf_dir, "documents"))
