"""Byte-pair encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import chunks

#: Fixed value: the public byte-level pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of known encodings that a worker keeps, of what follows a blank and of other pieces; and the longest, in letters, that are kept.
KEPT_ROWS, KEPT_PIECES, LONGEST_KEPT = 80 << 20, 8 << 20, 64
#: Token pairs whose compatibility a worker keeps.
KEPT_PAIRS = 400_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Kept:
    """What a worker knows, bounded in bytes: two generations, of which the older goes when the younger holds half the bound."""

    def __init__(self, most: int):
        self.most, self.young, self.old, self.held = most, {}, {}, 0

    def older(self, key: str) -> str | None:
        """What the older generation knows, which then counts as young."""
        if (found := self.old.get(key)) is not None:
            self.add(key, found)
        return found

    def add(self, key: str, value: str) -> None:
        if len(key) > LONGEST_KEPT:
            return
        if self.held >= self.most // 2:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value
        self.held += 220 + 2 * len(key) + len(value)  # two strings and a dictionary's place, as it grows


class Bpe:
    """One vocabulary. `encode_piece` is exact byte-pair encoding without merging anything.

    In byte-pair encoding every prefix of a piece has one encoding, and the encodings of prefixes extend each other along
    back-pointers: the last token of a prefix is the one vocabulary entry ending there that is compatible with the last
    token of the prefix before it. Candidates come from an automaton over the vocabulary (that of all entries
    at once, by Aho and Corasick, in the place of a suffix automaton): its suffix links list the entries that end at each byte; two tokens are compatible when merging their joined bytes gives the two back.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab, self.special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {i: raw(s) for s, i in vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        ids = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.rank.setdefault((left, right), n)
            self.parts.setdefault(whole, (left, right, n))
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.agree: dict[int, bool] = {}
        self.known, self.rows = Kept(KEPT_PIECES), Kept(KEPT_ROWS)
        self.faithful = True  # whether all pieces so far decode to themselves
        self.blanks = re.compile(r"\s | \s").search
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their joined bytes.

        Undo merges on both sides of the seam, the later one first. At each state, a merge across the seam that comes
        before the merge just undone would have been made first, and then a, b would not stand.
        """
        if (found := self.agree.get(pair := a << 32 | b)) is not None:
            return found
        none = len(self.rank)
        x, y, undone, ok = a, b, (none, 0), True
        while True:
            across = self.rank.get((x, y))
            # at equal rank the merge further left goes first; undone[1] is 1 if what was undone lies right of the seam
            if across is not None and (across, 1) <= undone:
                ok = False
                break
            px, py = self.parts.get(x), self.parts.get(y)
            if px is None and py is None:
                break
            if py is None or (px is not None and px[2] > py[2]):
                undone, x = (px[2], 0), px[1]
            else:
                undone, y = (py[2], 1), py[0]
        if len(self.agree) >= KEPT_PAIRS:
            self.agree.clear()
        self.agree[pair] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        # of each prefix the last token, and its length; nothing stands before the empty one
        last: list[int | None] = [-1, *[None] * len(piece)]
        sizes = [0] * (len(piece) + 1)
        agree = self.agree.get
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] is None and (before := last[end - size]) is not None:
                if before >= 0 and (fits := agree(before << 32 | token)) is not True and (fits is False or not self.compatible(before, token)):
                    continue
                last[end], sizes[end] = token, size
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= sizes[end]
        return out[::-1]

    def _new(self, piece: str) -> str:
        ids = self.encode_piece(piece.encode())
        self.faithful &= self.decode(ids) == piece
        return ",".join(map(str, ids))

    def _piece(self, piece: str) -> str:
        """A piece's ids. One that begins with a blank is kept as the row after that blank."""
        kept, key = (self.rows, piece[1:]) if piece[0] == " " else (self.known, piece)
        if (found := kept.young.get(key) or kept.older(key)) is None:
            found = self._new(piece)
            kept.add(key, found)
        return found

    def _row(self, row: str) -> str:
        """A blank and the text up to the next one, which no piece crosses."""
        if (found := self.rows.young.get(row) or self.rows.older(row)) is None:
            pieces = self.find(f" {row}")
            found = self._new(pieces[0]) if len(pieces) == 1 else ",".join(map(self._piece, pieces))
            self.rows.add(row, found)
        return found

    def joined(self, text: str) -> str:
        """The ids of a text in decimals, with commas between."""
        if not (text and self.split):
            parts = [text]
        else:
            parts = self.split(text)
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(str(self.special[part]))
            elif self.blanks(part) or part[:1] == " " or part[-1:] == " ":  # white space in a row takes its place among pieces from what is around it
                out += map(self._piece, self.find(part))
            else:
                head, *cut = part.split(" ")
                out += map(self._piece, self.find(head))
                found = list(map(self.rows.young.get, cut))
                out += [f or self._row(c) for f, c in zip(found, cut, strict=True)] if None in found else found
        return ",".join(out)

    def encode(self, text: str) -> list[int]:
        ids = self.joined(text)
        return [int(x) for x in ids.split(",")] if ids else []

    def decoded(self, text: str, ids: str) -> str:
        """What a text's ids decode to: the text itself if its pieces, each decoded when it was first met, all gave themselves back."""
        return text if self.faithful or not ids else self.decode([int(x) for x in ids.split(",")])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _over_texts(path: str, cells: Callable[[Bpe, str], tuple], fields: list[pa.Field]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for part, texts in chunks(batch, most=4 << 20):
                rows = [cells(model, t.decode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields))], names=["doc_id", *(f.name for f in fields)])

    return run


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids ARRAY<INT> and decoded STRING of each row of docs (doc_id LONG, text STRING); a null text is empty.

    path: the tokenizer file, readable on every executor. Repeated rows are each returned; a null doc_id stays null;
    other columns are ignored. Documents are independent: no shuffle, memory of one batch and a bounded piece cache.
    """
    cells = lambda m, t: (ids := m.encode(t), m.decode(ids))
    run = _over_texts(path or default_path(), cells, [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())])
    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "CAST(text AS STRING) text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _digest(model: Bpe, text: str) -> tuple:
    ids = model.joined(text)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return ids.count(",") + 1 if ids else 0, sha(ids), sha(model.decoded(text, ids))


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: what `encode_texts` gives, as digests. Same rules."""
    run = _over_texts(path or default_path(), _digest, [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())])
    return docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "CAST(text AS STRING) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
