"""Whole Arrow text columns to token ids with the tokenizers library."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words

#: Words that an encoder remembers between batches, at most; beyond that only those that were met again stay.
REMEMBERED = 800_000


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start[i] .. start[i] + length[i] - 1 of every i, one run after the other."""
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    return np.repeat(start - (end - length), length) + np.arange(total)


def by_words(spec: dict) -> bool:
    """Whether the tokenizer drops white space and never lets a token span it, so that encoding word by word is exact."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    norm = spec.get("normalizer") or {}
    kinds = [n.get("type") for n in norm.get("normalizers", [norm])]
    return (
        first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and r"[^\s\p{L}\p{N}]+" in json.dumps(first.get("pattern"), ensure_ascii=False).replace("\\\\", "\\")
        and kinds in (["NFC", "Replace", "Lowercase"], [None]) and not spec.get("post_processor")
    )


class Encoder:
    """encode() gives what Tokenizer.encode(text, add_special_tokens=False) gives for each whole text; a null is an empty text.

    Where by_words() holds, each distinct word is encoded once and remembered. A run of full stops and commas after an
    ASCII letter is a word of its own, as the pre-tokenizer cuts there anyway. What is left is lower-cased first if it is
    ASCII letters alone (the normaliser does so too); all else is encoded as it stands, as special tokens are matched
    before the normaliser, and NFC comes before Lowercase. Other tokenizers encode text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.exact_words = by_words(spec)
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.vocabulary, bool)
            self.ends[[i for w, i in spec["model"]["vocab"].items() if w.endswith(suffix)]] = True
        del spec
        words.give_back()
        self._clear()

    def _clear(self) -> None:
        self.key, self.check, self.at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.off = np.zeros(1, np.int64)

    def _shrink(self) -> None:
        """Keeps the words that were met again since they were learned or last kept; all go if those are over half of the room."""
        keep = np.flatnonzero(self.again[self.at])
        if len(keep) > REMEMBERED // 2:
            self._clear()
            return
        place = self.at[keep]
        length = self.off[place + 1] - self.off[place]
        ids = self.ids[gather(self.off[place], length)]
        self.key, self.check, self.at = self.key[keep], self.check[keep], np.arange(len(keep))
        self.again, self.off = np.zeros(len(keep), bool), np.concatenate([[0], np.cumsum(length)])
        self.ids = np.concatenate([ids, np.zeros(1 << 20, np.uint32)])

    def _fresh(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each string). Words of letters alone are encoded many to a text, as each is one pre-token, whose last id is one that ends words."""
        length = np.zeros(len(new), np.int64)
        plain = pc.utf8_is_alpha(new).to_numpy(zero_copy_only=False)
        which, runs, counts = np.flatnonzero(plain), [], []
        if self.ends is not None and len(which):
            some = new.take(pa.array(which))
            cut = np.append(np.arange(0, len(which), 256), len(which))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), some), " ").to_pylist()
            for i, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                last = np.flatnonzero(self.ends[ids])
                if len(last) != cut[i + 1] - cut[i] or last[-1] != len(ids) - 1:
                    plain[which[cut[i] : cut[i + 1]]] = False  # not as expected: these go one by one
                    continue
                runs.append((which[cut[i] : cut[i + 1]], ids))
                length[runs[-1][0]] = np.diff(last, prepend=-1)
        else:
            plain[:] = False
        alone = np.flatnonzero(~plain)
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(new.take(pa.array(alone)).to_pylist(), add_special_tokens=False)] if len(alone) else []
        length[alone] = [len(x) for x in lists]
        if len(alone):
            runs.append((alone, np.fromiter((x for e in lists for x in e), np.uint32, int(length[alone].sum()))))
        start = np.concatenate([[0], np.cumsum(length)])
        out = np.zeros(start[-1], np.uint32)
        for w, ids in runs:
            out[gather(start[w], length[w])] = ids
        return out, length

    def _places(self, strings: pa.Array) -> np.ndarray:
        """The numbers of remembered strings, after new ones are encoded. Two 64-bit hashes stand for a string."""
        key, check = words.hash_strings(strings), words.hash_strings(strings, words.OTHER_STEP)
        if len(self.key) and len(self.key) + len(strings) > REMEMBERED:
            self._shrink()
        found = np.full(len(strings), -1)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            same = (self.key[at] == key) & (self.check[at] == check)
            found[same] = self.at[at[same]]
            self.again[found[same]] = True
        new = np.flatnonzero(found < 0)
        if len(new):
            ids, length = self._fresh(strings.take(pa.array(new)))
            n, base = len(self.off) - 1, int(self.off[-1])
            if len(self.ids) < base + len(ids):
                self.ids = np.concatenate([self.ids[:base], np.zeros(len(ids) + (1 << 20), np.uint32)])
            self.ids[base : base + len(ids)] = ids
            self.off = np.concatenate([self.off, base + np.cumsum(length)])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            found[new] = n + np.arange(len(new))
            order = new[np.argsort(key[new], kind="stable")]
            spot = np.searchsorted(self.key, key[order])
            self.key, self.check, self.at = np.insert(self.key, spot, key[order]), np.insert(self.check, spot, check[order]), np.insert(self.at, spot, found[order])
        return found

    def _halves(self, uniques: pa.Array) -> np.ndarray:
        """The remembered places of each word's base (first half) and of its tail (second half)."""
        stem = pc.ascii_rtrim(uniques, characters=".,")
        raw, o = words.string_bytes(stem)
        size, full = np.diff(o), np.diff(words.string_bytes(uniques)[1])
        last = np.where(size > 0, raw[np.maximum(o[1:] - 1, 0)] if len(raw) else 0, 0)
        cut = (size < full) & ((last | 32) >= 97) & ((last | 32) <= 122)
        base = pc.if_else(pa.array(cut), stem, uniques)
        base = pc.if_else(pc.ascii_is_alpha(base), pc.ascii_lower(base), base)
        tail = pc.if_else(pa.array(cut), pc.utf8_slice_codeunits(pc.utf8_reverse(uniques), 0, 1), "")  # then grown to the run's length below
        runs = full - size
        if (long := np.flatnonzero(cut & (runs > 1))).size:
            listed = tail.to_pylist()
            whole = uniques.take(pa.array(long)).to_pylist()
            for i, w in zip(long.tolist(), whole):
                listed[i] = w[len(w) - int(runs[i]) :]
            tail = pa.array(listed, pa.string())
        both = pa.concat_arrays([base, tail]).dictionary_encode()
        return self._places(both.dictionary)[both.indices.to_numpy()]

    def count(self, texts: pa.Array) -> np.ndarray:
        """How many ids encode() gives for each text."""
        if not self.exact_words:
            return np.diff(self.encode(texts)[1])
        codes, off, uniques = words.split(texts, lower=False)
        place = self._halves(uniques)
        length = self.off[place + 1] - self.off[place]
        return words.run_sums((length[: len(uniques)] + length[len(uniques) :])[codes], off)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]]."""
        if not self.exact_words:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            return np.fromiter((x for e in lists for x in e), np.uint32, int(off[-1])), off
        codes, off, uniques = words.split(texts, lower=False)
        place = self._halves(uniques)
        n = len(uniques)
        start, length = self.off[place], self.off[place + 1] - self.off[place]
        # ids of each distinct word: those of its base, then those of its tail
        order = np.stack([np.arange(n), np.arange(n) + n], 1).ravel() if n else np.zeros(0, np.int64)
        pool = self.ids[gather(start[order], length[order])]
        each = length[:n] + length[n:]
        at = np.concatenate([[0], np.cumsum(each)])
        per_word = each[codes]
        out_off = np.concatenate([[0], np.cumsum(per_word)])[off]
        return pool[gather(at[:-1][codes], per_word)], out_off


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
