"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For every prefix of a word the table holds the one token that its encoding ends with: of the vocabulary tokens that
end there (matches of an Aho-Corasick automaton), the one that is compatible with the last token of the prefix
before it. Ids then follow backwards from the whole word. Two tokens are compatible when no merge across their
border would have come before the merges that built them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words that a Python worker keeps at hand, twice: those it met lately, and those it met before.
CACHE = 200_000


class PieceModel:
    """A BPE model with byte fallback, an added first space and no other normalisation."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  a ") != f"{SPACE}ﬁ{SPACE}{SPACE}a{SPACE}":
            raise ValueError(f"{path} normalises texts; only models with a first space and no other change are supported")
        self.ids: dict[str, int] = {}
        self.raw: list[bytes] = []
        self.byte_ids = [0] * 256
        rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.raw.append(b"" if model.is_control(i) else b" \xe2\x81\x87 ")
            else:
                self.ids[piece] = i
                rank[piece] = -model.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        self.runs = {p for p in self.ids if not p.strip(SPACE)}
        self.rank = {p: r for p, r in rank.items() if p not in self.runs or p == SPACE}
        if any(SPACE in p[1:] for p in self.rank) or len(set(self.rank.values())) < len(self.rank):
            raise ValueError(f"{path} has pieces with inner spaces or equal scores")
        self.automaton = ahocorasick.Automaton()
        for p in self.rank:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self.units = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._beside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self._spines: dict[str, tuple | None] = {}
        self._pairs: dict[str, dict[str, bool]] = {}
        self._tested = 0
        self._known: dict[str, tuple[int, bytes, bytes]] = {}
        self._older: dict[str, tuple[int, bytes, bytes]] = {}

    def _spine(self, token: str) -> tuple | None:
        """How merging builds the token: the parts along its right and its left border, as (part, built, used up).

        None if merging the token's characters does not end in the token.
        """
        if token in self._spines:
            return self._spines[token]
        parts: list[tuple] = [(c, -1.0, None, None) for c in token]  # text, when it is built, its two parts
        while len(parts) > 1:
            found = [(self.rank[t], i) for i in range(len(parts) - 1) if (t := parts[i][0] + parts[i + 1][0]) in self.rank]
            if not found:
                break
            r, i = min(found)
            a, b = parts[i], parts[i + 1]
            parts[i : i + 2] = [(a[0] + b[0], max(r, a[1], b[1]), a, b)]
        spine = None
        if len(parts) == 1:
            borders = []
            for side in (3, 2):
                node, used, border = parts[0], float("inf"), []
                while node:
                    border.append((node[0], node[1], used))
                    node, used = node[side], node[1]
                borders.append(border)
            spine = tuple(borders)
        self._spines[token] = spine
        return spine

    def _compatible(self, first: str, second: str) -> bool:
        before, after = self._spine(first), self._spine(second)
        if before is None or after is None:
            return False
        rank = self.rank
        for a, a_built, a_used in before[0]:
            for b, b_built, b_used in after[1]:
                r = rank.get(a + b)
                if r is not None and max(r, b_built) < a_used and max(r, a_built) <= b_used:
                    return False
        return True

    def tokens(self, word: str) -> list[str]:
        """The tokens of a text that has a space mark at most in front."""
        last: list[str | None] = [None] * (len(word) + 1)
        pairs, spines = self._pairs, self._spines
        for end, (token, size) in self.automaton.iter(word):
            end += 1
            if last[end] is not None:
                continue
            start = end - size
            if not start:
                if token in spines and spines[token] or self._spine(token):
                    last[end] = token
                continue
            before = last[start]
            if before is None:
                before = last[start] = word[start - 1]
            try:
                fits = pairs[before][token]
            except KeyError:
                fits = pairs.setdefault(before, {})[token] = self._compatible(before, token)
                self._tested += 1
            if fits:
                last[end] = token
        out, at = [], len(word)
        while at:
            token = last[at] or word[at - 1]
            out.append(token)
            at -= len(token)
        return out[::-1]

    def run(self, n: int) -> list[str]:
        """The tokens of n spaces: their pieces merge last, all with one score, from the left."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and SPACE * (stack[-1] + stack[-2]) in self.runs:
                stack[-2:] = [stack[-1] + stack[-2]]
        return [SPACE * k for k in stack]

    def unit(self, text: str) -> list[int]:
        core = text.lstrip(SPACE)
        spaces = len(text) - len(core)
        if core and spaces < 2:
            return self._numbers(self.tokens(text))
        tokens = self.tokens(SPACE * (spaces > 0) + core) if core else []
        if tokens and spaces and tokens[0] != SPACE:
            spaces -= 1
        elif tokens and spaces:
            tokens = tokens[1:]
        return self._numbers(self.run(spaces) + tokens)

    def _numbers(self, tokens: list[str]) -> list[int]:
        """The tokens' ids; a character without a token gets those of its bytes."""
        ids = [self.ids.get(t) for t in tokens]
        if None in ids:
            ids = [i for t in tokens for i in ([self.ids[t]] if t in self.ids else [self.byte_ids[b] for b in t.encode()])]
        return ids

    def _unit(self, text: str) -> tuple[int, bytes, bytes]:
        """The entry of a text that is not at hand: kept from before, put together where no piece can span two of its
        characters, or encoded."""
        known = self._older.get(text)
        if known is None:
            cuts = None if text.strip(SPACE).isalpha() else [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self._beside and text[i - 1] != SPACE]
            if cuts:
                parts = [self._known.get(u) or self._unit(u) for u in map(text.__getitem__, map(slice, [0, *cuts], [*cuts, None]))]
                known = (sum([u[0] for u in parts]), b",".join([u[1] for u in parts]), b"".join([u[2] for u in parts]))
            else:
                ids = self.unit(text)
                known = (len(ids), ",".join(map(str, ids)).encode(), b"".join([self.raw[i] for i in ids]))
        if len(self._known) >= CACHE:
            self._known, self._older = {}, self._known
        if len(self._spines) + self._tested >= CACHE:
            self._spines, self._pairs, self._tested = {}, {}, 0
        if len(text) < 100:
            self._known[text] = known
        return known

    def parts(self, text: str) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, ids as decimal text, their bytes) of each piece of text between which nothing merges."""
        if not text:
            return []
        slow = self._unit
        return [self._known.get(u) or slow(u) for u in self.units.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.parts(text) for i in ids.split(b",")]

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD one by one; the added first space goes."""
        data = b"".join(self.raw[i] for i in ids)
        return readable(data[1:] if data[:1] == b" " else data)


def readable(data: bytes) -> str:
    parts, at = [], 0
    while True:
        try:
            return "".join(parts) + data[at:].decode()
        except UnicodeDecodeError as e:
            parts += [data[at : at + e.start].decode(), "\ufffd"]
            at += e.start + 1


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One model per worker process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Per row of docs: its id, n_tokens, ids_sha256 and decoded_sha256; with ``whole`` also ids and decoded.

    A null or empty text has no ids and decodes to the empty text. Rows may repeat; other columns are not read.
    The model is read on the executors from ``path``.
    """
    kinds = dict(docs.dtypes)
    schema = "id {}, n_tokens long, ids_sha256 string, decoded_sha256 string".format(kinds[id_col])
    if whole:
        schema += ", ids array<int>, decoded string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text in part.column(1).to_pylist():
                    units = model.parts(text or "")
                    ids = b",".join([u[1] for u in units])
                    data = b"".join([u[2] for u in units])
                    data = data[1:] if data[:1] == b" " else data
                    row = [sum([u[0] for u in units]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(data).hexdigest()]
                    rows.append(row + [[int(i) for i in ids.split(b",")] if ids else [], readable(data)] if whole else row)
                columns = [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kept))]
                yield pa.RecordBatch.from_arrays(columns, names)
        release()

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if whole else 4]
    kept = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: len(names) - 1]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(apply, schema)
    return out.withColumnRenamed("id", id_col)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), model_path())
