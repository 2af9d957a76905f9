"""Token ids of whole texts by a public tokenizer file, fast enough for a corpus."""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts whose ids a worker remembers; beyond that it forgets all and starts again. Results don't depend on it.
REMEMBERED_PARTS = 600_000
#: Characters of text handled at once.
CHARS_AT_ONCE = 4_000_000

#: Fixed values of the tokenizer file word_bpe_49k.json, for parts of letters up to U+00FF, digits and ASCII signs:
#: how its pattern cuts lower-cased text into words.
PLAIN = re.compile("[!-~ß-öø-ÿÀ-ÖØ-Þ]*")
WORDS = re.compile("(?i:'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿÀ-ÖØ-Þ]+)|[0-9]|[^a-zA-Zß-öø-ÿÀ-ÖØ-Þ0-9]+")
SPECIAL = "<|"
#: Fixed values of the same file: its normaliser and pre-tokenizer, for which the short cut below is right.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet, for characters from U+0021 to U+00FF as UTF-8: printable bytes stand for themselves, the others
    follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter, extra = {}, 256
    for b in range(256):
        if b in printable:
            letter[b] = chr(b)
        else:
            letter[b], extra = chr(extra), extra + 1
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(33, 256)}


class WordTokenizer:
    """Ids of a tokenizer that drops white space, lower-cases and never joins words: part by part between spaces.

    A part seen before costs a look-up. New plain parts are cut into words here and given to the file's own merge model in
    bulk; parts with any other character go through the whole tokenizer. `encode` of the whole text is the definition,
    and tests hold this against it. A file that cuts text in any other way is not taken apart: it encodes whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_PARTS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        told = json.loads(self.whole.to_str())
        self.apart = told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [CUT, BYTES]} and told["model"].get("end_of_word_suffix") == "</w>"
        self.words = Tokenizer(self.whole.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        self.letters, self.most = byte_letters(), remembered
        self.ends = np.zeros(max(self.whole.get_vocab().values()) + 1, dtype=bool)
        self.ends[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Part 0 is the text's end, id 0; known tells each part's number, of which `flat` has `sizes` ids from `first`."""
        self.known: dict[str, int] = {}
        self.flat, self.first, self.sizes = np.zeros(1, dtype="<u4"), np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)

    def learn(self, parts: list[str]) -> None:
        plain = [p for p in parts if PLAIN.fullmatch(p) and SPECIAL not in p]
        other = [p for p in parts if not (PLAIN.fullmatch(p) and SPECIAL not in p)]
        flats, sizes = [self.flat], [self.sizes]
        for k in range(0, len(plain), 5000):
            cut = [WORDS.findall(p) for p in plain[k : k + 5000]]
            text = " ".join([w for c in cut for w in c]).lower().translate(self.letters)
            ids = np.array(self.words.encode(text, add_special_tokens=False).ids, dtype="<u4")
            stops = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            flats.append(ids)
            sizes.append(np.diff(stops[np.concatenate([[0], np.cumsum([len(c) for c in cut])])]))
        for p in other:
            flats.append(np.array(self.whole.encode(p, add_special_tokens=False).ids, dtype="<u4"))
            sizes.append(np.array([len(flats[-1])]))
        self.known.update(zip([*plain, *other], range(len(self.sizes), len(self.sizes) + len(parts)), strict=True))
        self.flat, self.sizes = np.concatenate(flats), np.concatenate(sizes)
        self.first = np.cumsum(self.sizes) - self.sizes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (nulls as empty), each text's followed by id 0, and where each text's ids start and end."""
        if not self.apart:
            coded = self.whole.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            each = [np.array([*c.ids, 0], dtype="<u4") for c in coded]
            return np.concatenate(each) if each else np.zeros(0, dtype="<u4"), np.cumsum([0, *map(len, each)])
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        if not pc.any(pc.match_substring(texts, SPECIAL)).as_py():  # what follows changes no id, and fewer parts are new
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-z])([.,]) ", "\\1 \\2 ")
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        parts = coded.dictionary.to_pylist()
        if new := [p for p in parts if p not in self.known]:
            if len(self.known) + len(new) > self.most:
                self.forget()
                new = parts
            self.learn(new)
        number = np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        index = np.insert(number[coded.indices.to_numpy()], bounds[1:], 0)
        counts = self.sizes[index]
        stop = np.cumsum(counts)
        places = np.repeat(self.first[index] - (stop - counts), counts) + np.arange(stop[-1] if len(stop) else 0)
        ends = np.concatenate([[0], stop])[bounds + np.arange(len(bounds))]
        return self.flat[places], ends


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that what a task learned serves the next."""
    return WordTokenizer(path)


def chunks(texts: pa.Array, most: int = CHARS_AT_ONCE):
    """(first row, row after the last) of runs of rows of so many bytes at most, or of a single row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held + n > most and k > at:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)
