"""BPE encoding and decoding by prefix-sharing traversal of a trie of distinct words.

The distinct new words of a piece of text are taken in sorted order, which is the depth-first order of their trie: the
part that a word shares with the one before it is not computed again. The state of a trie node is the last token of the
encoding of the prefix that ends there. It is the one token, among those that end the prefix, which can stand after the last
token of the prefix before it, that is, where merging both again gives the same two tokens. Following these tokens back
from the last symbol gives a word's encoding. So each node is computed once, whatever the number of words below it.

Normalisation (NFC, white space, lower case), the split into words, byte symbols, the end-of-word mark and the special
tokens follow the tokenizer file; a file that asks for anything else is refused. Letters, numbers and lower case are those of
Unicode 16, as in the tokenizers library, whatever Python has. The file is read on the driver; only what is used of it travels.

Defined results: a null text counts as empty, and an empty text has no tokens and decodes to an empty text. Special
tokens that stand literally in a text become their ids, as in the library. Words and texts may be of any length; the work on
a word grows with its length. Repeated rows are encoded alike. An empty table gives an empty result. Columns of the input are
kept, whatever their names; the added ones replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from tidemark.llm.common import CACHES, map_text

MOST_WORDS, MOST_BYTES, MOST_PAIRS = 250_000, 16 << 20, 300_000  # whose encodings a worker keeps (and as many of before), their size, and token pairs
#: Fixed values of Unicode 16: letters and numbers that Unicode 15.1 doesn't have, white space, and lower case that is new.
_LETTERS_16 = "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
_NUMBERS_16 = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LOWER_16 = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {i: i + 32 for i in range(0x10D50, 0x10D66)} | {i: i + 27 for i in range(0x16EA0, 0x16EB9)}
_new_upper = re.compile("[" + "".join(map(chr, _LOWER_16)) + "]").search


@cache
def _class(kind: str, added: str) -> str:
    """Members of a set in a pattern: the ranges of Unicode 15.1 in general category `kind`, and `added`."""
    ranges: list[list[int]] = []
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(chr(i))[0] == kind:
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in ranges) + added


#: What a file may ask for besides its vocabulary, merges, added tokens and split pattern.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "decoder": None,
    "post_processor": None,
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def checked(spec: dict) -> dict:
    """The parts of a tokenizer file that are used; ValueError if it asks for something else."""
    steps = spec["pre_tokenizer"].get("pretokenizers", [])
    off = [k for k, v in KNOWN.items() if spec.get(k) != v] + [k for k, v in _MODEL.items() if (spec["model"].get(k) or None) != (v or None)]
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[0].get("behavior") != "Removed" or not steps[0].get("invert") or steps[1].get("add_prefix_space") or steps[1].get("use_regex", True):
        off.append("pre_tokenizer")
    off += ["added_tokens" for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
    if off:
        raise ValueError(f"unknown {', '.join(off)} in the tokenizer file")
    return {k: spec[k] for k in ("model", "added_tokens", "pre_tokenizer")}


def _byte_symbols() -> list[str]:
    """Byte -> its printable stand-in: printable Latin-1 stays, the others take code points from 256 on in order."""
    stays = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in stays else chr(256 + extra))
        extra += b not in stays
    return out


class Bpe:
    """A BPE model with end-of-word mark, as its tokenizer file describes it."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.pairs: dict[int, bool] = {}  # token numbers, the first one times 2**32
        self.codes: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation of codes before
        self.held = 0  # bytes of codes, about
        self.ranks: dict[tuple[str, str], int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks.setdefault((sys.intern(a), sys.intern(b)), i)
        self.end: str = model.get("end_of_word_suffix") or ""
        names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.names = np.array([names.get(i) for i in range(max(names) + 1)], object)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]  # the file has these classes in brackets only
        letters, numbers = _class("L", _LETTERS_16), _class("N", _NUMBERS_16)
        self.find = re.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", _SPACE)).findall
        members = lambda among: "".join(f"\\x{i:02x}" for i in range(256) if re.match(f"[{among}]", chr(i)))  # noqa: E731  within Latin-1, for speed
        self.find_latin = re.compile(pattern.replace(r"\p{L}", members(letters)).replace(r"\p{N}", members(numbers)).replace(r"\s", members(_SPACE))).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.bytes = _byte_symbols()
        self.longest = max(len(t) for t in self.vocab)
        self.good = {t: i for t, i in self.vocab.items() if self.merged(self.start(t)) == [t]}  # those that merging can reach
        self.sizes = [len(t) if t else 0 for t in self.names.tolist()]
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.sizes))]

    # words

    def symbols(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() and " " not in word else "".join(map(self.bytes.__getitem__, word.encode("utf-8", "replace")))

    def merged(self, parts: list[str]) -> list[str]:
        """Merges by rank, first place first: the definition that states are checked by, on a few symbols only."""
        rank, none = self.ranks.get, 1 << 40
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def start(self, token: str) -> list[str]:
        """A token's symbols; the last one holds the end mark."""
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def can_follow(self, a: int, b: int) -> bool:
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        x, y = self.names[a], self.names[b]
        known = self.pairs[a << 32 | b] = self.merged(self.start(x) + self.start(y)) == [x, y]
        return known

    def learn(self, words: Iterable[str]) -> None:
        """Encodes distinct words; each trie node on their paths once."""
        last, end, sizes, packed, codes = self._last, self.end, self.sizes, self.packed, self.codes
        good, known, longest, held = self.good.get, self.pairs.get, self.longest, self.held
        path = ""
        states: list[int] = []  # the last token of each prefix of path
        for original, word in sorted(((w, self.symbols(w)) for w in words), key=lambda p: p[1]):
            body = len(word) - (1 if end else 0)
            shared, most = 0, min(len(path), body)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del states[shared:]
            path = word[:body]
            for i in range(shared, body):  # as _last() does, in line for speed
                stop = i + 1
                token = good(word[:stop]) if stop <= longest else None
                if token is None:
                    for start in range(i, max(0, stop - longest - 1), -1):
                        if (token := good(word[start:stop])) is not None:
                            before = states[start - 1]
                            if (fits := known(before << 32 | token)) or fits is None and self.can_follow(before, token):
                                break
                    else:
                        raise ValueError(f"no token of the vocabulary ends {word[:stop]!r}")
                states.append(token)
            at, tokens = len(word), []
            if end:
                tokens.append(token := last(word, at, end, states))
                at -= sizes[token] - len(end)
            while at:
                tokens.append(token := states[at - 1])
                at -= sizes[token]
            tokens.reverse()
            codes[original] = code = b"".join([packed[t] for t in tokens])
            held += len(word) + len(code)
        self.held = held

    def _last(self, word: str, stop: int, end: str, states: list[int]) -> int:
        """The last token of the encoding of word[:stop] + end. Only one can be right, so short ones are tried first."""
        good, known = self.good.get, self.pairs.get
        if (token := good(word[:stop] + end)) is not None:
            return token
        for start in range(stop - 1, max(0, stop - self.longest - 1), -1):
            if (token := good(word[start:stop] + end)) is not None:
                before = states[start - 1]
                if (fits := known(before << 32 | token)) or fits is None and self.can_follow(before, token):
                    return token
        raise ValueError(f"no token of the vocabulary ends {word[:stop]!r}")

    # texts

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _new_upper(text):
                text = text.translate(_LOWER_16)
        text = text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find(text)
        return self.find_latin(text)

    def segments(self, text: str) -> list[list[str] | str]:
        """Word lists and, between them, special tokens."""
        if self.cut is None or not any(s in text for s in self.special):
            return [self.words(text)]
        return [part if i % 2 else self.words(part) for i, part in enumerate(self.cut(text))]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.segments(t) for t in texts]
        new = set(chain.from_iterable(s for parts in cut for s in parts if not isinstance(s, str)))
        missing = new - self.codes.keys()
        if len(self.codes) + len(missing) > MOST_WORDS or self.held > MOST_BYTES:
            self.old, self.codes, self.held = self.codes, {}, 0
            missing = new
        kept = missing & self.old.keys()  # words in use outlive the others
        self.codes.update((w, self.old[w]) for w in kept)
        self.held += sum(len(w) + len(self.old[w]) for w in kept)
        self.learn(missing - kept)
        code = self.codes.__getitem__
        return [b"".join(self.special[s].to_bytes(4, "little") if isinstance(s, str) else b"".join(map(code, s)) for s in parts) for parts in cut]

    def clear(self) -> None:
        self.codes.clear()
        self.old.clear()
        self.pairs.clear()
        self.held = 0

    def decode(self, ids: np.ndarray) -> str:
        """The file names no decoder: tokens stand between blanks."""
        return " ".join(self.names[ids].tolist())


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


_models: dict[str, Bpe] = {}


class _Models:
    """A worker's models, dropped with its other caches."""

    clear = staticmethod(_models.clear)


CACHES.append(_Models)


def _model(spec: str) -> Bpe:
    """One model a worker process and file."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _models:
        _models[key] = Bpe(json.loads(spec))
    return _models[key]


def _apply(docs: DataFrame, path: str, given: str, keep: list[str] | None, fields: list[StructField], make: Callable[[Bpe, list], list[pa.Array]]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(json.dumps(checked(load(path))))
    return map_text(docs, given, fields, lambda column: make(_model(sent.value), column.to_pylist()), keep)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, name: str = "ids") -> DataFrame:
    """docs with their token ids (array of int) in a column `name`."""

    def make(model: Bpe, texts: list) -> list[pa.Array]:
        ids = model.encode_all([t or "" for t in texts])
        ends = np.concatenate(([0], np.cumsum([len(b) // 4 for b in ids]))).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))]

    return _apply(docs, path, text, keep, [StructField(name, ArrayType(IntegerType()))], make)


def decode(docs: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None, name: str = "decoded") -> DataFrame:
    """docs with the text of their ids in a column `name`; null ids count as none."""

    def make(model: Bpe, rows: list) -> list[pa.Array]:
        return [pa.array([model.decode(np.asarray(r or [], np.int64)) for r in rows], pa.string())]

    return _apply(docs, path, ids, keep, [StructField(name, StringType())], make)


def digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens and the digests of ids and of the decoded text, encoded and decoded in one pass."""
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]

    def make(model: Bpe, texts: list) -> list[pa.Array]:
        found = model.encode_all([t or "" for t in texts])
        text = [hashlib.sha256(model.decode(np.frombuffer(b, "<u4")).encode()).hexdigest() for b in found]
        return [pa.array([len(b) // 4 for b in found], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in found], pa.string()), pa.array(text, pa.string())]

    return _apply(docs, path, text, keep, fields, make)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path(), keep=["doc_id"])
