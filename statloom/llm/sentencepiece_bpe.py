"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For every prefix of a text the BPE encoding ends in exactly one token, so a table with
one token a prefix holds the whole encoding. It is filled from left to right: an
Aho-Corasick automaton names all vocabulary pieces that end at a place, and the one
whose left neighbour (the table's entry where the piece starts) is *compatible* with it
is the entry. Two tokens are compatible when encoding their joined text gives the two
tokens back. Ids are then recovered backwards from the last entry.

Pieces of the supported models never hold the blank mark after another character, so no
merge crosses from a non-blank to a blank: the text splits there into chunks that are
encoded one by one, and chunks that were met before come from a bounded cache.

Supported: BPE models with byte fallback, identity normalisation, a dummy prefix and no
removal of extra white space; others raise ValueError. Defined results: a null text is
an empty one, and an empty text has no ids and decodes to an empty text; very long texts
are encoded whole; repeated rows give repeated results; an empty table gives none. Columns
named like new ones are replaced. Of merges with equal scores the leftmost comes first.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from statloom.llm.common import CHUNK, spans, text_buffer, with_arrow_columns, worker_cache

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Chunks kept by a worker, and the longest one that is kept.
CACHE_CHUNKS, CACHE_CHARS = 200_000, 48
#: Answers about pairs of tokens that a worker keeps.
CACHE_PAIRS = 1_500_000
NEVER = float("-inf")
#: The table's entry of the empty prefix. Every token fits there, and none after a prefix
#: without an entry.
_START = -2
_ENDS = {_START: True, -1: False}


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model: a bounded table that the driver reads and ships."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    byte_ids: tuple[int, ...]


def read_vocabulary(model_path: str) -> Vocabulary:
    """Read a model file on the driver."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kinds = model.normalizer_spec, model.SentencePiece
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are supported")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError("models with user-defined or unused pieces are not supported")
    normal = tuple(p.type == kinds.NORMAL for p in model.pieces)
    if any(MARK in p.piece.lstrip(MARK) for p, n in zip(model.pieces, normal, strict=True) if n):
        raise ValueError("a piece holds a blank after another character")
    by_byte = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
    return Vocabulary(tuple(p.piece for p in model.pieces), tuple(p.score for p in model.pieces), normal, tuple(by_byte[f"<0x{b:02X}>"] for b in range(256)))


class PrefixTable:
    """Encoder and decoder over a vocabulary; one lives in each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.id_of = {p: k for k, (p, n) in enumerate(zip(vocabulary.pieces, vocabulary.normal, strict=True)) if n}
        self.score_of = {p: vocabulary.scores[k] for p, k in self.id_of.items()}
        self.letters = {c for p in self.id_of for c in p}
        #: Tokens of the table: pieces that encode to themselves, and letters without a
        #: piece. Of each: its ids as text, whether its merges come in falling order of
        #: score, and the symbols at its left and right end in order of time, each with
        #: the score of the merge that ends it.
        self.tokens: list[str] = []
        self.size: list[int] = []
        self.ids: list[list[int]] = []
        self.ordered: list[bool] = []
        self.left: list[tuple[list[str], list[float]]] = []
        self.right: list[tuple[list[str], list[float]]] = []
        #: Of each token: which tokens fit before it, as far as asked.
        self.pairs: list[dict[int, bool]] = []
        self.automaton = ahocorasick.Automaton()
        for text in sorted({*self.id_of, *self.letters}):
            parts, merges = self._merge(text)
            if len(parts) != 1:
                continue  # no text ever encodes to this piece
            times = [s for s, _, _ in merges]
            self.pairs.append(dict(_ENDS))
            self.automaton.add_word(text, (len(text), len(self.tokens), self.pairs[-1]))
            self.tokens.append(text)
            self.size.append(len(text))
            self.ids.append([self.id_of[text]] if text in self.id_of else self._bytes(text))
            self.ordered.append(all(a > b for a, b in zip(times, times[1:], strict=False)))
            for side, end in ((self.left, text[0]), (self.right, text[-1])):
                own = [(s, p) for s, at, p in merges if (at == 0 if side is self.left else at + len(p) == len(text))]
                side.append(([end, *(p for _, p in own)], [*(s for s, _ in own), NEVER]))
        self.automaton.make_automaton()
        self.spoken = [p.replace(MARK, " ") if n else "" for p, n in zip(vocabulary.pieces, vocabulary.normal, strict=True)]
        #: Each token's id as text, empty where a letter has no piece.
        self.token_text = [str(i[0]) if t in self.id_of else "" for t, i in zip(self.tokens, self.ids, strict=True)]
        self.known = re.compile(f"[{''.join(map(re.escape, sorted(self.letters)))}]+")
        self.pair_count = 0
        self.words: dict[str, tuple[str, str]] = {}

    def _merge(self, text: str) -> tuple[list[str], list[tuple[float, int, str]]]:
        """BPE as defined: join the neighbours with the best score, the leftmost first.
        Gives the parts and, in order of time, (score, start, piece) of each merge."""
        parts, merges = list(text), []
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score_of.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts, merges
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            merges.append((best, sum(map(len, parts[:at])), parts[at]))

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joined text of two tokens encodes to these two tokens."""
        if not (self.ordered[a] and self.ordered[b]):
            parts, _ = self._merge(self.tokens[a] + self.tokens[b])
            return parts == [self.tokens[a], self.tokens[b]]
        # Both tokens' merges come in falling order of score, so time is score. Walk
        # through the states of the two symbols that touch the border; the border falls
        # when joining them would come before the next merge on either side.
        (u, end_u), (v, end_v), score = self.right[a], self.left[b], self.score_of.get
        i = j = 0
        while True:
            next_u, next_v = end_u[i], end_v[j]
            across = score(u[i] + v[j])
            if across is not None and across > next_u and across >= next_v:
                return False
            if next_u >= next_v:
                if next_u == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _tokens(self, text: str) -> list[int]:
        """Tokens of a text whose characters all occur in pieces."""
        last = [-1] * (len(text) + 1)
        last[0] = _START
        for end, (length, token, fits) in self.automaton.iter(text, 0):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            fit = fits.get(before)
            if fit is None:
                self.pair_count += 1
                if self.pair_count > CACHE_PAIRS:
                    for kept in self.pairs:
                        kept.clear()
                        kept.update(_ENDS)
                    self.pair_count = 1
                fit = fits[before] = self.compatible(before, token)
            if fit:
                last[end] = token
        out, at, size = [], len(text), self.size
        while at:
            token = last[at]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def _bytes(self, text: str) -> list[int]:
        return [self.v.byte_ids[b] for b in text.encode("utf-8", "replace")]

    def encode_chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for run in self.known.finditer(chunk):
            if run.start() > at:
                ids += self._bytes(chunk[at : run.start()])
            for token in self._tokens(run[0]):
                ids += self.ids[token]
            at = run.end()
        return ids + self._bytes(chunk[at:]) if at < len(chunk) else ids

    def decode_chunk(self, ids: list[int]) -> str:
        normal, spoken = self.v.normal, self.spoken
        if all([normal[k] for k in ids]):
            return "".join([spoken[k] for k in ids])
        out, run = [], bytearray()
        for k in ids:
            if not normal[k] and len(self.v.pieces[k]) == 6:
                run.append(int(self.v.pieces[k][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(spoken[k])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text) of one chunk."""
        if self.letters.issuperset(chunk):
            spelled = [self.token_text[t] for t in self._tokens(chunk)]
            if "" not in spelled:  # pieces only, and pieces joined are the text
                return ",".join(spelled), chunk.replace(MARK, " ")
        ids = self.encode_chunk(chunk)
        return ",".join(map(str, ids)), self.decode_chunk(ids)

    def _word(self, word: str) -> tuple[str, str]:
        """A word after one blank, which becomes part of the cache."""
        made = self._chunk(MARK + word)
        if len(word) <= CACHE_CHARS:
            if len(self.words) >= CACHE_CHUNKS:
                self.words.clear()
            self.words[word] = made
        return made

    def _parts(self, text: str) -> list[tuple[str, str]]:
        if not text:
            return []
        words = text.split(" ")
        if MARK not in text and "" not in words:
            kept, make = self.words.get, self._word
            return [kept(w) or make(w) for w in words]
        return [self._chunk(c) for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]

    def encode(self, text: str) -> list[int]:
        return [int(k) for ids, _ in self._parts(text) for k in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_chunk(ids)
        return text[1:] if ids and self.v.pieces[ids[0]].startswith(MARK) else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text)."""
        parts = self._parts(text)
        ids = ",".join([p[0] for p in parts])
        back = "".join([p[1] for p in parts])
        back = back[1:]  # the dummy prefix, whose blank always opens the first piece
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()


def _table(vocabulary: Vocabulary) -> PrefixTable:
    tables = worker_cache("sentencepiece")
    key = hash((vocabulary.pieces, vocabulary.scores))
    if key not in tables:
        tables.clear()
        tables[key] = PrefixTable(vocabulary)
    return tables[key]


def _texts(column: pa.Array):
    _, offsets, _ = text_buffer(column)
    for i, j in spans(offsets, CHUNK):
        for t in column.slice(i, j - i):
            yield t.as_py() or ""


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (the text that the ids decode to)."""
    share = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))

    def make(column: pa.Array) -> list:
        table, ids, back = _table(share.value), [], []
        for text in _texts(column):
            ids.append(table.encode(text))
            back.append(table.decode(ids[-1]))
        return [ids, back]

    return with_arrow_columns(docs, text_col, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], make, "sentencepiece")


def encode_digests(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: the digests of
    what ``encode`` gives, made in the workers so that ids need not be moved."""
    share = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))

    def make(column: pa.Array) -> list:
        table = _table(share.value)
        rows = [table.digest(t) for t in _texts(column)]
        return [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return with_arrow_columns(docs, text_col, fields, make, "sentencepiece")


def default_model() -> str:
    """The public tokenizer that the query uses; any other path can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sentencepiece_query(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    return encode_digests(docs.select("doc_id", "text"), model_path or default_model()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
