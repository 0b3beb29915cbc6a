"""BPE encoding and decoding with a contiguous rank array.

A word is held as a list of part boundaries and a parallel list with the merge rank of each
adjacent pair. The smallest rank is found by scanning, its inner boundary is deleted and the two
neighbouring ranks are refreshed. Words are short, so the scan beats a heap; words of more than
``LONG_WORD`` bytes, for which the scan would be quadratic, take a heap over linked parts and
give the same parts.

Defined results: a null text counts as empty; an empty text has no ids, ``n_tokens`` 0 and decodes
to the empty string; repeated rows are each encoded; whole texts are encoded, whatever their
length; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparquill.llm.columns import documents
from sparquill.llm.memory import releasing

LONG_WORD = 256
CACHE_CHUNKS, CACHE_WORDS = 400_000, 250_000
NO_RANK = 1 << 60

# Code points, in hexadecimal, that the library's Unicode tables class, order or lower-case in another way
# than those of Python 3.13 and of the regex module (letters and marks of later versions). Texts with one go to the library's own steps.
OTHER_TABLES = """
558 58b-58c 7fd 88f 898-89f 8ca-8d3 9fe c3c c5c cdc d3b-d3c eba 1715 1abf-1ace 1c89 1df6-1dfa 208f 209d-209f a7cb-a7cc a7ce-a7cf a7d2 a7d4
a7da a7dc-a7dd a7e2 a7f1 a82c ab6c-ab6d 107bb-107bf 10940-10959 10d24-10d27 10d50-10d65 10eab-10eac 10ec5-10ec7 10ed9-10eee 10efd-10eff
10f46-10f50 10f82-10f85 11070 1133b 1145e 11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11b0a 11d42 11d44-11d45 11d97
11db0-11ddb 11de0-11de9 11df1 11f41-11f42 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff0-16ff6 187f8-187ff 18cd6-18cda
18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e08f 1e130-1e136
1e2ae 1e2ec-1e2ef 1e4ec-1e4ef 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead
323b0-33479 3d000-3fc3f
"""


def byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: itself if visible, else from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def read_model(path: str) -> dict:
    """Vocabulary, merges, suffix, split pattern and special tokens of a tokenizer file, as plain values."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "vocab": spec["model"]["vocab"],
        "merges": [tuple(m) for m in spec["model"]["merges"]],
        "suffix": spec["model"]["end_of_word_suffix"] or "",
        "pattern": split["pattern"]["Regex"],
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class WordBPE:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, model: dict, cache_chunks: int = CACHE_CHUNKS, cache_words: int = CACHE_WORDS):
        self.cache_chunks, self.cache_words = cache_chunks, cache_words
        self.vocab, self.suffix, self.special = model["vocab"], model["suffix"], model["special"]
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.rank = {pair: i for i, pair in enumerate(model["merges"])}
        self.words = regex.compile(model["pattern"])
        self.alphabet = byte_alphabet()
        self.pattern = model["pattern"]
        self.other = re.compile("[" + "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in OTHER_TABLES.split()) + "]")
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(self.alphabet)})
        self.cache: dict[bytes, tuple[str, str]] = {}
        self.pieces: dict[str, tuple[str, str]] = {}  # the same for single pre-tokens

    def normal(self, text: str) -> str:
        """Composed and in lower case, character by character: a final capital sigma is no special case."""
        if not text.isascii() and self.other.search(text):
            from tokenizers import normalizers

            return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def library_words(self, text: str) -> list[str]:
        from tokenizers import Regex, pre_tokenizers

        return [w for w, _ in pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True).pre_tokenize_str(text)]

    def parts(self, word: str) -> list[str]:
        """The merged parts of one pre-token."""
        chars = list(word.encode().decode("latin-1").translate(self.letters))
        chars[-1] += self.suffix
        return self._heap(chars) if len(chars) > LONG_WORD else self._scan(chars)

    def _scan(self, chars: list[str]) -> list[str]:
        rank, text = self.rank.get, "".join(chars)
        bounds = [*range(len(chars)), len(text)]
        ranks = [rank(pair, NO_RANK) for pair in zip(chars, chars[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            at = ranks.index(low)
            del bounds[at + 1], ranks[at]
            here = text[bounds[at] : bounds[at + 1]]
            if at:
                ranks[at - 1] = rank((text[bounds[at - 1] : bounds[at]], here), NO_RANK)
            if at < len(ranks):
                ranks[at] = rank((here, text[bounds[at + 1] : bounds[at + 2]]), NO_RANK)
        return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _heap(self, chars: list[str]) -> list[str]:
        part: list[str | None] = list(chars)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap = [(r, i, p) for i, p in enumerate(zip(chars, chars[1:], strict=False)) if (r := self.rank.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if part[i] is None or j < 0 or (part[i], part[j]) != pair:
                continue
            part[i], part[j] = pair[0] + pair[1], None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := self.rank.get(p := (part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a, p))
        return [p for p in part if p is not None]

    def _word(self, word: str) -> tuple[str, str]:
        hit = self.pieces.get(word)
        if hit is None:
            if len(self.pieces) >= self.cache_words:
                self.pieces.clear()
            parts = self.parts(word)
            hit = self.pieces[word] = " ".join([str(self.vocab[p]) for p in parts]), " ".join(parts)
        return hit

    def _chunk(self, chunk: bytes) -> tuple[str, str]:
        """Ids and tokens of a run without ASCII white space, each joined by spaces."""
        text = chunk.decode()
        words = self.library_words(text) if not chunk.isascii() and self.other.search(text) else self.words.findall(text)
        found = [self._word(w) for w in words]
        return found[0] if len(found) == 1 else (" ".join([i for i, _ in found]), " ".join([t for _, t in found]))

    def encode_joined(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by one space, and the decoded text."""
        ids: list[str] = []
        decoded: list[str] = []
        cache = self.cache
        for piece in self.cut.split(text) if "<|" in text else (text,):
            if piece in self.special:
                ids.append(str(self.special[piece]))
                decoded.append(piece)
                continue
            for chunk in self.normal(piece).encode().split():
                hit = cache.get(chunk)
                if hit is None:
                    if len(cache) >= self.cache_chunks:
                        cache.clear()
                    hit = cache[chunk] = self._chunk(chunk)
                if hit[0]:
                    ids.append(hit[0])
                    decoded.append(hit[1])
        return " ".join(ids), " ".join(decoded)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_joined(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as for a vocabulary file that names no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_encoders: dict[tuple, WordBPE] = {}


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache_chunks: int = CACHE_CHUNKS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """``doc_id``, ``ids`` (decimal, joined by spaces), ``n_tokens`` and ``decoded`` of every whole text.

    The vocabulary has a fixed size; the driver reads the file once and broadcasts it. The cache sizes are
    a worker's memory against its time, about 300 bytes an entry; they change no result.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = path, cache_chunks, cache_words
        if key not in _encoders:  # a worker process keeps its encoder and word cache across tasks
            _encoders[key] = WordBPE(model.value, cache_chunks, cache_words)
        bpe = _encoders[key]
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                pairs = [bpe.encode_joined(t) for t in texts[at : at + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids[at : at + 256],
                        pa.array([i for i, _ in pairs], pa.large_string()),
                        pa.array([i.count(" ") + 1 if i else 0 for i, _ in pairs], pa.int64()),
                        pa.array([d for _, d in pairs], pa.large_string()),
                    ],
                    names=["doc_id", "ids", "n_tokens", "decoded"],
                )

    return documents(docs, id_col, text_col).mapInArrow(releasing(run), "doc_id long, ids string, n_tokens long, decoded string")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
