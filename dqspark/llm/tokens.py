"""Token ids of whole texts from a public tokenizer file, memoised per word where the tokenizer drops white space."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A full memo is emptied; this bounds memory and does not change ids.
MEMO_WORDS = 600_000
GROUP_WORDS = 50
# Words whose ids are laid out at once.
LAID_WORDS = 100_000

# ASCII signs that end a word of letters or digits; an apostrophe may start a contraction instead.
TAILS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TAILS = {TAILS[i : i + 1] for i in range(len(TAILS))}


def word_wise(config: dict) -> bool:
    """Whether ids of a text are those of its white-space separated words, one after the other.

    True for BPE with word ends whose pre-tokenizer cuts at a pattern and drops what does not match, white space
    included, after a normaliser that works on single characters and their marks.
    """
    pre = config.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [])
    cut = steps[0] if steps else {}
    normal = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
    return (
        config["model"].get("type") == "BPE"
        and bool(config["model"].get("end_of_word_suffix"))
        and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and (cut["behavior"], cut["invert"]) == ("Removed", True)
        and "[^\\s" in cut["pattern"].get("Regex", "")
        and not steps[1]["add_prefix_space"]
        and set(normal) <= {"NFC", "Replace", "Lowercase"}
        and all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in config["added_tokens"])
    )


def _latin1(text: str) -> bool:
    """Such texts have no combining marks and lower-case sign by sign, so lower-casing ahead changes no id."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _ends_plain(stem: bytes) -> bool:
    """Whether a letter or ASCII digit ends it; what follows from TAILS is then a piece of its own."""
    if stem[-1:].isascii():
        return stem[-1:].isalnum()
    return stem.decode()[-1].isalpha()


class Encoder:
    """encode(texts) gives the ids of each text as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_word = word_wise(config)
        self.lower = "Lowercase" in str(config.get("normalizer"))
        self.special = tuple({t["content"][:2] for t in config["added_tokens"]})
        self.memo: dict[bytes, bytes] = {}
        suffix = config["model"].get("end_of_word_suffix") or "\0"
        vocabulary = config["model"]["vocab"]
        self.ends = np.zeros(1 + max(vocabulary.values(), default=0), bool) if isinstance(vocabulary, dict) else np.zeros(0, bool)
        for token, i in vocabulary.items() if isinstance(vocabulary, dict) else ():
            self.ends[i] = token.endswith(suffix)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words. Words of letters alone are one piece each, which ends at its one word-end token, so many of
        them go to the library as one text."""
        out: list[bytes] = [b""] * len(words)
        letters, others = [], []
        for i, w in enumerate(words):
            (letters if w.lower().isalpha() else others).append(i)
        groups = [letters[i : i + GROUP_WORDS] for i in range(0, len(letters), GROUP_WORDS)]
        for group, packed in zip(groups, self._plain([" ".join(words[i] for i in g) for g in groups])):
            cuts = [0, *(4 * (np.flatnonzero(self.ends[np.frombuffer(packed, "<u4")]) + 1)).tolist()]
            if len(cuts) != len(group) + 1:
                others += group
                continue
            for i, a, b in zip(group, cuts, cuts[1:]):
                out[i] = packed[a:b]
        for i, packed in zip(others, self._plain([words[i] for i in others])):
            out[i] = packed
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Put distinct words into the memo."""
        memo = self.memo
        new = [w for w in words if w not in memo]
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = words
        split, whole = {}, set()
        for w in new:
            if w[-1:] in _TAILS:
                stem = w.rstrip(TAILS)
                if _ends_plain(stem):
                    split[w] = (stem, w[len(stem) :])
                    whole.update(split[w])
                    continue
            whole.add(w)
        order = [w for w in whole if w not in memo]
        memo.update(zip(order, self._words([w.decode() for w in order])))
        for w, (stem, tail) in split.items():
            memo[w] = memo[stem] + memo[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._plain(texts)
        # A text that may hold a special token goes to the library as it is.
        plain = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(plain, self._plain([texts[i] for i in plain])):
            out[i] = ids
        rest = sorted(set(range(len(texts))).difference(plain))
        if not rest:
            return out
        # Each distinct word of these texts is looked up once; ids are then laid out by word number.
        cut = pc.ascii_split_whitespace(pa.array([self._lowered(texts[i]) for i in rest], pa.large_string()))
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        self._learn(words)
        known = [self.memo[w] for w in words]
        ids = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        word = coded.indices.to_numpy()
        ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        for begin, texts_there in _runs(ends, LAID_WORDS):
            a, b = ends[begin], ends[begin + texts_there]
            size = sizes[word[a:b]]
            after = np.cumsum(size)
            total = int(after[-1]) if len(after) else 0
            packed = ids[np.repeat(starts[word[a:b]] - (after - size), size) + np.arange(total)].tobytes()
            text_ends = np.concatenate([[0], after])[ends[begin : begin + texts_there + 1] - a] * 4
            for i, x, y in zip(rest[begin : begin + texts_there], text_ends.tolist(), text_ends[1:].tolist()):
                out[i] = packed[x:y]
        return out

    def _lowered(self, text: str) -> str:
        return text.lower() if self.lower and _latin1(text) else text


def _runs(ends: np.ndarray, words: int):
    """First text and number of texts of stretches of at most `words` words, or of one text."""
    begin, last = 0, len(ends) - 1
    while begin < last:
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + words, "right")) - 1)
        yield begin, min(stop, last) - begin
        begin = min(stop, last)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, kept from task to task with its memo."""
    return Encoder(path)


def in_chunks(texts: list[str], chars: int = 1_500_000):
    """Index ranges of at most `chars` characters (or one text), to bound what is in work at once."""
    begin = held = 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > chars:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)
