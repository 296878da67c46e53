"""BPE encoding and decoding with a contiguous rank array per word.

A vocabulary file in the tokenizers library's JSON form gives the merges. A word is held as its part boundaries and, next
to them, the rank of the merge of each part with the one after it. The least rank is found by a scan, its boundary is
deleted, and only the two neighbouring ranks are looked up again. Words recur, so each worker keeps the encodings of up
to CACHE_WORDS words, in two halves: when the newer one is full, the older goes. Text is encoded whole.

White space only parts words, whatever it is, so the files' step that makes it one space is left out.

Encoding matches the library for files whose normalizer is NFC, white space to one space, lower case, whose words come
from a pattern, and whose merges run over byte symbols with a word-end suffix; any other file is refused.
Decoding has no decoder in such files: the tokens' strings are joined by spaces.

Edge cases: null and empty text give no ids and an empty decoded text; strings of special tokens become their ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanloom.llm.arrowio import bounded, slices

CACHE_WORDS = 200_000
#: Text bytes that are encoded before their rows are passed on.
CHUNK_BYTES = 1 << 19
NO_RANK = 1 << 60
#: Fixed value: the word pattern of the files read here.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The white space among the first code points.
SPACE = r"\t-\r \x85\xa0"
#: Lower case of letters that the library knows and Python's tables do not yet; first, last, shift.
NEW_LOWER_RANGES = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
]
NEW_LOWER = {c: c + shift for first, last, shift in NEW_LOWER_RANGES for c in range(first, last + 1)}


#: Ranges that the regex module counts as letters or numbers and the library's older Unicode tables do not.
NOT_YET = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


def early_words() -> re.Pattern:
    """WORDS for texts without code points from U+0558 on, with their letters and numbers listed, which is faster."""
    listed = {k: "".join(rf"\u{c:04x}" for c in range(0x558) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{listed['L']}]+|[{listed['N']}]|[^{SPACE}{listed['L']}{listed['N']}]+")


def newer_words() -> regex.Pattern:
    """WORDS with the library's letters and numbers, for texts with code points from U+0558 on."""
    new = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in NOT_YET)
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{new}]]+|[\p{{N}}--[{new}]]|(?:[^\s\p{{L}}\p{{N}}]|[{new}])+", regex.V1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next unused one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file's text."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model, norm, pre = d["model"], d["normalizer"], d["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in norm["normalizers"]], [x["type"] for x in pre]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or d["post_processor"] or d["decoder"] or pre[1]["use_regex"]:
            raise ValueError("this vocabulary file has another normalizer, splitter or decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.end = model["end_of_word_suffix"]
        self.bits = max(self.vocab.values()).bit_length()
        self.ranks: dict[int, int] = {}  # the pair's ids in one number, to its rank and the merged id in one
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.vocab[a] << self.bits | self.vocab[b]] = rank << self.bits | self.vocab[a + b]
        pattern = pre[0]["pattern"]["Regex"]
        if pattern != WORDS:
            raise ValueError("this vocabulary file has another word pattern")
        self.words = early_words()
        self.beyond, self.newer = re.compile("[\u0558-\U0010ffff]"), None
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.end] for s in symbols]
        self.newer_words: dict[str, tuple[bytes, str]] = {}
        self.older_words: dict[str, tuple[bytes, str]] = {}

    def ids(self, word: str) -> list[int]:
        """The rank-array loop over one non-empty word."""
        data = word.encode()
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        look, bits = self.ranks.get, self.bits
        merge = [look(a << bits | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        low = (1 << bits) - 1
        while merge:
            least = min(merge)
            if least == NO_RANK:
                break
            i = merge.index(least)
            parts[i] = new = least & low
            del parts[i + 1], merge[i]
            if i:
                merge[i - 1] = look(parts[i - 1] << bits | new, NO_RANK)
            if i < len(merge):
                merge[i] = look(new << bits | parts[i + 1], NO_RANK)
        return parts

    def look_up(self, word: str) -> tuple[bytes, str]:
        """(ids as little-endian uint32 bytes, token strings joined by spaces) of a word that newer_words lacks."""
        out = self.older_words.get(word)
        if out is None:
            ids = self.ids(word)
            out = struct.pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids])
        if len(word) <= 64:
            if len(self.newer_words) >= CACHE_WORDS:
                self.newer_words.clear()
            self.newer_words[word] = out
        return out

    def encoded(self, words: list[str]) -> list[tuple[bytes, str]]:
        """Of every word; between calls the halves of the cache change places when the newer one is full."""
        if len(self.newer_words) >= CACHE_WORDS // 2:
            self.newer_words, self.older_words = {}, self.newer_words
        known, look_up = self.newer_words.get, self.look_up
        return [known(w) or look_up(w) for w in words]

    def split(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not self.beyond.search(text):
            return self.words.findall(text)
        if self.newer is None:
            self.newer = newer_words()
        return self.newer.findall(text.translate(NEW_LOWER))

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as bytes, decoded text) of a whole text."""
        pieces = [text] if not self.specials or "<|" not in text else self.specials.split(text)
        out: list[tuple[bytes, str]] = []
        for piece in pieces:
            if piece in self.special:
                out.append((np.array([self.special[piece]], "<u4").tobytes(), piece))
            elif piece:
                out += self.encoded(self.split(piece))
        return b"".join([x[0] for x in out]), " ".join([x[1] for x in out])

    def decode(self, ids) -> str:
        """Unknown ids are left out, as the library does."""
        return " ".join([self.strings[int(i)] for i in ids if int(i) in self.strings])


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Adds n_tokens long, ids_sha256, decoded_sha256 and, if asked for, token_ids array<int> to every row.

    The file's text (under 2 MB) travels with the function; ``path`` is only read on the driver.
    """
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    names = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")]
    kept = docs.select(*[f"`{c}`" for c in names])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), added])
    drop = text_col not in names

    def run(batches):
        coder = WordBpe(spec.value)
        whole = (b.slice(i, j - i) for b in batches for i, j in slices(b.column(names.index(text_col)), CHUNK_BYTES))
        for batch in whole:
            n, ids_hash, text_hash, ids = [], [], [], []
            for t in batch.column(names.index(text_col)):
                packed, decoded = coder.encode(t.as_py() or "")
                n.append(len(packed) // 4)
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype("i4"))
            out = [*batch.columns, pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids])

    assert not drop, f"no column {text_col}"
    return bounded(kept).mapInArrow(run, schema)


def op2(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
