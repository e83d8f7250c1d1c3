"""BPE encoding and decoding, with tree concatenation for long unsplit text.

A tokenizer file of the tokenizers library gives vocabulary, normalizer and pre-tokenizer.
Text of Latin letters, digits and ASCII marks is cut into pre-tokenizer pieces directly (where
the file has the normalizer and pattern that this needs); other text is cut at ASCII white
space, which no merge, composition or special token crosses. Pieces and chunks are encoded
by the library through a bounded cache. A chunk longer than
``LONG`` bytes is normalized and pre-tokenized by the library; a piece of it that stays
longer is cut into fragments, these are encoded in parallel (one batch call), and neighbours
are joined pairwise up a binary tree: a window of k tokens on both sides of the join is
encoded again, k doubling until the first and last token of the window come out unchanged.
A sequence is the BPE encoding of its text if and only if every two neighbouring tokens
are the encoding of their own text, so agreement at both edges makes the join exact.

Edge cases: null counts as empty (no tokens, digest of the empty string); repeated rows give
repeated results; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerspark.llm.common import lean

LONG, FRAGMENT, FIRST_WINDOW, CACHE = 2048, 1024, 4, 400_000
#: Fixed by the tokenizer file: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Of these characters the normalizer only lower-cases and folds white space, each on its own.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_L = r"a-z\u00df-\u00f6\u00f8-\u00ff"
PLAIN_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\t-\r\x20{_L}0-9]+")


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str, long: int = LONG, fragment: int = FRAGMENT) -> None:
        from tokenizers import Tokenizer, models

        self.long, self.fragment = long, fragment
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        self.suffix = spec.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        self.open = Tokenizer(models.BPE(vocab=spec["vocab"], merges=merges))  # of text within a word: no word end
        special = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.name = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.known: dict[bytes | str, tuple[str, int, str]] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = kinds == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern", {}).get("Regex") == PATTERN and spec["decoder"] is None

    def _ended(self, piece: str) -> list[int]:
        return [t.id for t in self.whole.model.tokenize(piece)]

    def _join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Tokens of both texts together; last: right holds the word's end."""
        k = FIRST_WINDOW
        while True:
            a, b = left[-k:], right[:k]
            text = "".join(self.name[i] for i in a + b)
            closed = last and k >= len(right)
            if closed:
                ids = self._ended(text[: len(text) - len(self.suffix)] if self.suffix else text)
            else:
                ids = self.open.encode(text, add_special_tokens=False).ids
            if (k >= len(left) or ids[0] == a[0]) and (k >= len(right) or ids[-1] == b[-1]):
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            k *= 2

    def piece(self, text: str) -> list[int]:
        """Tokens of one pre-tokenized piece (in the alphabet of the vocabulary)."""
        if len(text) <= self.long:
            return self._ended(text)
        parts = [text[i : i + self.fragment] for i in range(0, len(text), self.fragment)]
        level = [e.ids for e in self.open.encode_batch(parts[:-1], add_special_tokens=False)] + [self._ended(parts[-1])]
        while len(level) > 1:
            n = len(level)
            level = [self._join(level[i], level[i + 1], i + 2 >= n) if i + 1 < n else level[i] for i in range(0, n, 2)]
        return level[0]

    def long_chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for i, part in enumerate(self.special.split(chunk) if self.special else [chunk]):
            if i % 2:
                ids.append(self.whole.token_to_id(part))
            elif part:
                text = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(text):
                    ids += self.piece(piece)
        return ids

    def _entry(self, ids: list[int]) -> tuple[str, int, str]:
        return " ".join(map(str, ids)), len(ids), self.whole.decode(ids, skip_special_tokens=False) if ids else ""

    def _plain(self, text: str) -> list[tuple[str, int, str]]:
        """The same for text that PLAIN matches and that holds no special token."""
        pieces, known = PLAIN_PIECE.findall(text.lower()), self.known
        new = set(pieces).difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set(pieces)
        for w in new:
            [(letters, _)] = self.whole.pre_tokenizer.pre_tokenize_str(w)
            ids = self.piece(letters)
            known[w] = " ".join(map(str, ids)), len(ids), " ".join([self.name[i] for i in ids])
        return [known[w] for w in pieces]

    def chunks(self, data: bytes) -> list[tuple[str, int, str]]:
        """Ids, their number and the decoded text of each chunk that has tokens."""
        if self.plain and PLAIN.fullmatch(text := data.decode()) and not (self.special and self.special.search(text)):
            return self._plain(text)
        words, known = data.split(), self.known
        if new := [w for w in dict.fromkeys(words) if w not in known]:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(dict.fromkeys(words))
            short = [w for w in new if len(w) <= self.long]
            for w, e in zip(short, self.whole.encode_batch([w.decode() for w in short], add_special_tokens=False), strict=True):
                known[w] = self._entry(e.ids)
            for w in new:
                if len(w) > self.long:
                    known[w] = self._entry(self.long_chunk(w.decode()))
        return [x for x in map(known.__getitem__, words) if x[1]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.chunks(text.encode()) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids, skip_special_tokens=False)


def encode_decode(docs: DataFrame, tokenizer_path: str, real: bool = False) -> DataFrame:
    """Per document the number of tokens and digests of ids and decoded text; real: the ids and decoded text themselves too."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * real

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(tokenizer_path)
            n, ids, decoded = [], [], []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                found = codec.chunks(data or b"")
                n.append(sum(x[1] for x in found))
                ids.append(" ".join([x[0] for x in found]))
                decoded.append(" ".join([x[2] for x in found]))
            hexes = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in c]) for c in (ids, decoded)]
            columns = [batch.column(0), pa.array(n, pa.int64()), *hexes]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if real:
                columns += [pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lean(run), schema)
