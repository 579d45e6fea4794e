"""A byte-pair tokenizer of the word kind, run over a trie of distinct words.

The vocabulary file is the tokenizers library's JSON with: NFC, white space to one
space, lower case; a split pattern; byte-level letters; a suffix on the last symbol
of each word.

Method.  An encoding by ranked merges has the property that the encoding of a
prefix, without its last token, is the encoding of the shorter prefix; so one
number for each prefix, its last token, holds the whole encoding.  Distinct words
are put in a trie; the trie is walked depth first; each node's last token is found
once, from the nodes above it, however many words share the prefix.  A token may
follow another exactly if the two, joined, encode to themselves; these verdicts are
kept.  The last symbol of a word carries the suffix and is a leaf of the trie.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Recent, trim

#: Code points below this take the fast path, where Python's rules were compared with the library's.
_FAST_END = 0x250
#: Verdicts on pairs of tokens that are kept (some 100 bytes each).
MOST_VERDICTS = 150_000


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def _spread(code: np.ndarray, size: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a pool that codes stand for, one after the other, and where each ends (0 first)."""
    count = size[code]
    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    return pool[np.repeat((np.cumsum(size) - size)[code] - ends[:-1], count) + np.arange(ends[-1])], ends


def _listed(strings: pa.Array) -> list[str]:
    """As to_pylist, by the quicker way through numpy."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def _rows(lists: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """The ids of the entries of lists as one list a row."""
    of_row = lists.offsets.to_numpy().astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends[of_row - of_row[0]].astype(np.int32)), pa.array(ids, pa.int32()))


class WordBpe:
    """Encoder and decoder; `encode_column` and `decode_column` are what the operators call."""

    def __init__(self, spec: str, cache_bytes: int = 24 << 20, by_library: bool = False):
        """by_library: words not met before are encoded by the library's model itself, not by the trie."""
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.symbols_of = {i: len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t, i in self.vocab.items()}
        #: Of the last two symbols: the lengths of the tokens that end so, in symbols, longest first.
        self.reach: dict[str, tuple[int, ...]] = {}
        ends: dict[str, set[int]] = {}
        for t, i in self.vocab.items():
            if (n := self.symbols_of[i]) > 1:
                ends.setdefault(t[-2 - len(self.suffix) :] if self.suffix and t.endswith(self.suffix) else t[-2:], {1}).add(n)
        for tail, sizes in ends.items():
            self.reach[tail] = tuple(sorted(sizes, reverse=True))
        self.letters = byte_letters()
        self.made_at = dict.fromkeys(self.vocab.values(), -1)  # token -> rank of the merge that makes it; symbols: -1
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank_of_ids: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank_of_ids[x << 20 | y] = rank
            if self.made_at[z] < 0:
                self.made_at[z], self.parts[z] = rank, (x, y)
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.cache = Recent(cache_bytes)
        self._special_ids = {t: array("i", [i]).tobytes() for t, i in self.special.items()}
        self._special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Without its model where that isn't asked for: the normalizer and the split pattern are all that is left of it.
        bare = data | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}
        library = Tokenizer.from_str(spec if by_library else json.dumps(bare))
        library.no_padding()
        library.no_truncation()
        self._model = Tokenizer(library.model) if by_library else None
        ends = np.zeros(max(self.names) + 1, dtype=bool)
        ends[[i for t, i in self.vocab.items() if self.suffix and t.endswith(self.suffix)]] = True
        self._ends = ends
        self._names = pa.array([self.names.get(i) for i in range(max(self.names) + 1)], pa.string())
        self._normal = library.normalizer or normalizers.Sequence([])
        self._split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), behavior="removed", invert=True)
        self._fast_rules(split["pattern"]["Regex"])

    # -- pre-tokens

    def _fast_rules(self, pattern: str) -> None:
        """Sort code points below _FAST_END by asking the library; those where Python differs take the slow path."""
        from tokenizers import Regex, pre_tokenizers

        def of(kind: str) -> set[int]:
            test = pre_tokenizers.Split(Regex(kind), behavior="removed", invert=True)
            return {c for c in range(_FAST_END) if test.pre_tokenize_str(chr(c))}

        letter, number, space = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
        same = {c for c in range(_FAST_END) if c in space or self._normal.normalize_str(chr(c)) == unicodedata.normalize("NFC", chr(c)).lower()}
        lower = pc.utf8_lower(pa.array([chr(c) for c in range(_FAST_END)])).to_pylist()
        parted = pc.list_value_length(pc.utf8_split_whitespace(pa.array([f"a{chr(c)}b" for c in range(_FAST_END)]))).to_pylist()
        safe = {c for c in same if (c in space) == (not chr(c).split()) == (parted[c] == 2) and lower[c] == chr(c).lower() and all(ord(x) < _FAST_END for x in lower[c])}
        group = lambda s: "".join(f"\\u{c:04x}" for c in sorted(s))
        self._unsafe = re.compile(f"[^{group(safe)}]")
        self._unsafe_arrow = "[^" + "".join(f"\\x{{{c:x}}}" for c in sorted(safe)) + "]"
        heads = [h for h in pattern.split("|") if re.fullmatch(r"'\w+", h)]
        self._words = re.compile(words := f"[{group(letter)}]+|[{group(number)}]|{'|'.join(heads)}|[^\\s{group(letter | number)}]+")
        self._lined = re.compile(words + "|\n")

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text in order, special tokens among them."""
        if self._special_re and "<|" in text:
            out = []
            for part in self._special_re.split(text):
                out += [part] if part in self.special else self._plain_words(part)
            return out
        return self._plain_words(text)

    def _plain_words(self, text: str) -> list[str]:
        if not self._unsafe.search(text):
            return self._words.findall(text.lower())
        return [w for w, _ in self._split.pre_tokenize_str(self._normal.normalize_str(text))]

    # -- the trie

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain merging by rank, for the verdicts on single tokens only."""
        parts = list(symbols)
        while len(parts) > 1:
            ids = [self.vocab[x] for x in parts]
            rank, at = min((self.rank_of_ids.get(a << 20 | b, 1 << 60), i) for i, (a, b) in enumerate(itertools.pairwise(ids)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token.removesuffix(self.suffix)
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _stands(self, token: int) -> bool:
        """Whether a token's own text encodes to it."""
        if (known := self._whole.get(token)) is None:
            name = self.names[token]
            known = self._whole[token] = self._merge(self._symbols(name)) == [name]
        return known

    def _follows(self, left: int, right: int) -> bool:
        """Whether two tokens, joined, encode to themselves.

        Go back in time from the two tokens: undo the later of the merges that made
        what stands at the joint (of two alike, the right one, as the leftmost goes
        first).  The two stay apart unless, at some time, what stood at the joint
        could merge before the merge that was undone.
        """
        key = left << 20 | right
        if (known := self._pairs.get(key)) is not None:
            return known
        ranks, made, parts = self.rank_of_ids.get, self.made_at, self.parts
        limit, x, y, apart = 1 << 60, left, right, True
        while True:
            rank = ranks(x << 20 | y)
            if rank is not None and rank < limit:
                apart = False
                break
            at_x, at_y = made[x], made[y]
            if at_x > at_y:
                limit, x = at_x, parts[x][1]
            elif at_y >= 0:
                limit, y = at_y + 1, parts[y][0]
            else:
                break
        self._pairs[key] = apart
        return apart

    def encode_words(self, words) -> dict[str, bytes]:
        """word -> ids as 32-bit integers in bytes.

        Words in order are the depth-first walk of their trie: what a word shares
        with the one before is the path kept.  path[n] is the last token of the
        first n symbols; exactly one token in the vocabulary that ends there can
        follow the last token of what precedes it.
        """
        letters, out = self.letters, {}
        if len(self._pairs) > MOST_VERDICTS:
            self._pairs.clear()
        vocab, pairs, whole, reach, sizes, suffix = self.vocab.get, self._pairs.get, self._whole.get, self.reach.get, self.symbols_of, self.suffix
        mapped = sorted([("".join([letters[b] for b in w.encode()]), w) for w in set(words) if w])
        path: list[int] = [0]
        before, one = "", (1,)
        for word, original in mapped:
            n = len(word)
            shared, most = 0, min(n, len(before)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, n + 1):
                ending = suffix if end == n else ""
                for size in reach(word[end - 2 : end] + ending, one) if end > 1 else one:
                    at = end - size
                    if at < 0:
                        continue
                    token = vocab(word[at:end] + ending)
                    if token is None:
                        continue
                    if at:
                        left = path[at]
                        good = pairs(left << 20 | token)
                        if good is None:
                            good = self._follows(left, token)
                    else:
                        good = whole(token)
                        if good is None:
                            good = self._stands(token)
                    if good:
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                path.append(token)
            token, at, ids = path.pop(), n, []
            while True:
                ids.append(token)
                at -= sizes[token]
                if at <= 0:
                    break
                token = path[at]
            ids.reverse()
            out[original] = array("i", ids).tobytes()
            before = word
        return out

    def _by_model(self, words: list[str]) -> dict[str, bytes]:
        """As encode_words, by the library's own model; a word's last token is the one that carries the suffix."""
        letters, out = self.letters, {}
        for at in range(0, len(words), 4_096):
            some = words[at : at + 4_096]
            mapped = [w if w.isascii() and w.isprintable() else "".join([letters[b] for b in w.encode()]) for w in some]
            ids = np.array(self._model.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype=np.int32)
            cut = [0, *(4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            out.update(zip(some, [raw[a:b] for a, b in itertools.pairwise(cut)], strict=True))
        return out

    # -- texts

    def _of_words(self, words: list[str], often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of distinct words, and all their ids.  Words not met before go through the trie together; those that come often are kept."""
        found = self.cache.many(words)
        lost = [w for w, ids in zip(words, found, strict=True) if ids is None and w]
        if lost or "" in words:
            made = self._by_model(lost) if self._model else self.encode_words(lost)
            made[""] = b""
            for i in np.flatnonzero(often).tolist():
                if found[i] is None:
                    self.cache.put(words[i], made[words[i]], len(made[words[i]]))
            found = [made[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        if self.special:
            found = [self._special_ids.get(w, ids) for w, ids in zip(words, found, strict=True)] if self._special_ids.keys() & words else found
        return np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4, np.frombuffer(b"".join(found), dtype=np.int32)

    def _of_lists(self, lists: pa.Array) -> pa.ListArray:
        """The ids of lists of words."""
        coded = lists.flatten().dictionary_encode()
        words = _listed(coded.dictionary)
        code = coded.indices.to_numpy()
        ids, ends = _spread(code, *self._of_words(words, np.bincount(code, minlength=len(words)) > 1))
        return _rows(lists, ids, ends)

    def _of_plain(self, texts: pa.Array) -> pa.ListArray:
        """Texts in which Arrow's and Python's rules are the library's.  No pre-token crosses white space, so distinct pieces between white space are split once."""
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        coded = lists.flatten().dictionary_encode()
        pieces, piece = _listed(coded.dictionary), coded.indices.to_numpy()
        split = pa.array(self._lined.findall("\n".join(pieces)), pa.string()).dictionary_encode()
        words, code = _listed(split.dictionary), split.indices.to_numpy()
        lines = [i for i, w in enumerate(words) if w == "\n"]
        for i in lines:
            words[i] = ""
        of_piece = np.cumsum(code == lines[0]) if lines else np.zeros(len(code), dtype=np.int64)
        times = np.bincount(piece, minlength=len(pieces))
        size, pool = self._of_words(words, np.bincount(code, weights=times[of_piece] if len(code) else None, minlength=len(words)) > 1)
        ids, _ = _spread(code, size, pool)
        sizes = np.bincount(of_piece, weights=size[code], minlength=len(pieces)).astype(np.int64)
        return _rows(lists, *_spread(piece, sizes, ids))

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        """For each text its ids as a list of 32-bit integers; null is empty."""
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.or_(pc.match_substring_regex(texts, self._unsafe_arrow), pc.match_substring(texts, "<|"))
        if not len(texts) or not pc.any(odd).as_py():
            return self._of_plain(texts)
        rare = self._of_lists(pa.array([self.words(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string())))
        mask = odd.to_numpy(zero_copy_only=False)
        order = np.argsort(np.concatenate([np.flatnonzero(~mask), np.flatnonzero(mask)]), kind="stable")
        return pa.concat_arrays([self._of_plain(texts.filter(pc.invert(odd))), rare]).take(pa.array(order))

    def forget(self) -> None:
        """Drop what was learnt of words, so that an idle worker holds the vocabulary alone."""
        self.cache = Recent(self.cache.half * 2)
        self._pairs.clear()

    def decode_column(self, lists: pa.ListArray) -> pa.Array:
        """As the library's decode without a decoder: the tokens' texts joined by one space; null lists are empty, null or unknown ids are left out."""
        ids = lists.flatten()
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        known = ids.is_valid().to_numpy(zero_copy_only=False) if ids.null_count else np.ones(len(ids), dtype=bool)
        value = pc.fill_null(ids, 0).to_numpy()
        known &= (value >= 0) & (value < len(self._names))
        names = self._names.take(pa.array(np.where(known, value, 0)))
        if names.null_count or not known.all():
            known &= names.is_valid().to_numpy(zero_copy_only=False)
            names = names.filter(pa.array(known))
            ends = np.concatenate([[0], np.cumsum(known)])[ends]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), names), " ")


@lru_cache(maxsize=2)
def coder(spec: str, by_library: bool = False) -> WordBpe:
    """One coder for each Python worker and vocabulary."""
    made = WordBpe(spec, 40 << 20 if by_library else 24 << 20, by_library)
    trim()
    return made
