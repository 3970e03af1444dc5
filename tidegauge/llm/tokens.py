"""Token ids of whole texts, by parts that the tokenizer never joins.

Both tokenizers cut a text at white space, and between a word and the punctuation after it, before they
merge anything, so the ids of a text are the ids of its parts in order. Each worker numbers the parts it has
met and keeps their ids in one array, which saves most of the merging; a text's ids are gathered by the numbers
of its parts. Of a full worker's parts those that are used again stay. The tokenizer's file is a parameter and
must exist on every executor.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np

from tidegauge.llm.common import worker_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts that stay when a worker has met twice as many, and the longest part that stays.
REMEMBERED = 300_000
LONGEST = 64
#: New parts go to the tokenizer in strings of so many.
JOINED = 1000
SEPARATOR = "<|endoftext|>"
#: Characters of a text that are cut into parts together.
STRETCH = 1_000_000

# Unicode white space, as the tokenizers' own patterns see it, and letters surely seen as such.
_WS = "\\t-\\r \\x85\\xa0  -     　"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Byte-level: a word with the one white-space character before it; longer runs but for their last one.
LEADING_SPACE = re.compile(f"[{_WS}]?[{_LETTER}]+(?=[,.;:!?{_WS}]|$)|[{_WS}]?[^{_WS}]+|[{_WS}]+(?=[{_WS}][^{_WS}])|[{_WS}]+")
#: White space is dropped by the tokenizer itself: words between ASCII white space.
WORDS = re.compile(f"[{_LETTER}]+(?=[,.;:!? \\t-\\r]|$)|[^ \\t-\\r]+")

_BLANK = re.compile(f"(?<=[^{_WS}]) (?=[^{_WS}])")


class Places(dict):
    """Numbers of parts in the order they were met; ``new`` holds those whose ids are not known yet."""

    def __init__(self, parts: Sequence = ()):
        super().__init__(zip(parts, range(len(parts))))
        self.new: list = []

    def __missing__(self, part) -> int:
        self[part] = place = len(self)
        self.new.append(part)
        return place


class PartEncoder:
    """``ids(texts)`` as the tokenizer of ``path`` gives them, with the ids of special tokens where a text has their
    strings.

    A special token's string is taken out of a text before anything else is done to it, so what lies before and behind
    it is cut into parts on its own. ``folds``: the tokenizer maps capitals to small letters and drops white space, so
    words that differ in capitals are merged once, and a part is all that stands between ASCII white space (in UTF-8),
    which is cut into words and marks when it is met first.
    """

    def __init__(self, path: str, parts: re.Pattern, folds: bool):
        self.path, self._plain = path, None
        self.joined = self._load()
        self.separator = self.joined.token_to_id(SEPARATOR)
        self.parts, self.folds = parts, folds
        added = [t for t in self.joined.get_added_tokens_decoder().items() if t[1].special]
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added):
            raise ValueError("special tokens that take their surroundings are not supported")
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in added}
        longest_first = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.at_special = re.compile(f"({'|'.join(longest_first)})") if self.special else None
        keys = [c.encode() for c in self.special] if folds else list(self.special)
        self.places, self.n_special, self.held = Places(keys), len(keys), 0
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)
        self._append(list(self.special.values()))
        # Words of letters alone are joined as they stand: each has one token that marks its edge, the first
        # with a space before it or the last with a word end.
        self.spaced = parts.pattern == LEADING_SPACE.pattern
        self.word = re.compile(f" [{_LETTER}]+" if self.spaced else f"[{_LETTER}]+")
        vocabulary = self.joined.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("\u0120") if self.spaced else token.endswith("</w>")
        self.cutter = self._cutter() if folds else self.joined

    def _load(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _cutter(self):
        """The tokenizer for words of small letters: it cuts at blanks alone and has no normalizer. A tokenizer of which a
        trial gives other ids is used as it is."""
        from tokenizers import pre_tokenizers

        made = self._load()
        made.normalizer = None
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = [c for c in map(chr, range(0x100)) if re.fullmatch(f"[{_LETTER}]", c)]
        trial = " ".join(a + b for a in letters for b in letters[::7])
        ours, theirs = (t.encode(x, add_special_tokens=False).ids for t, x in ((made, trial.lower()), (self.joined, trial)))
        return made if ours == theirs else self.joined

    @property
    def plain(self):
        """The tokenizer for what looks like special tokens and is none; few workers need it."""
        if self._plain is None:
            self._plain = self._load()
            self._plain.encode_special_tokens = True
        return self._plain

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[np.ndarray] = []
        some: list[str] = []
        n = 0
        for t in texts:
            if n + len(t) > STRETCH and some:
                out += self._ids(some)
                some, n = [], 0
            if len(t) > STRETCH:
                out.append(np.concatenate([self._ids([x])[0] for x in self._stretches(t)]))
            else:
                some.append(t)
                n += len(t)
        return out + (self._ids(some) if some else [])

    def _stretches(self, text: str) -> Iterator[str]:
        """A long text in stretches that end before a single blank between two words, where no part goes on."""
        at = 0
        while len(text) - at > STRETCH:
            blank = _BLANK.search(text, at + STRETCH)
            if blank is None:
                break
            yield text[at : blank.start()]
            at = blank.start()
        yield text[at:]

    def _ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        cut = [self._parts(t) for t in texts]
        counts = [len(parts) for parts in cut]
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(cut)), np.int32, sum(counts))
        if self.places.new:
            self._learn()
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        self.uses += np.bincount(at, minlength=len(self.uses))
        if len(self.places) > 2 * REMEMBERED or max(self.held, len(self.flat)) > 2 * LONGEST * REMEMBERED:
            self._forget()
        edges = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].tolist()
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def _parts(self, text: str) -> list:
        if not self.special or not any(s in text for s in self.special):
            return text.encode().split() if self.folds else self.parts.findall(text)
        out = []
        for i, some in enumerate(self.at_special.split(text)):
            if self.folds:
                out += [some.encode()] if i % 2 else some.encode().split()
            else:
                out += [some] if i % 2 else self.parts.findall(some)
        return out

    def _append(self, ids: list[bytes]) -> None:
        """Ids of the next places."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(ids), np.int64)])

    def _forget(self) -> None:
        """Keep the parts that are used most among those that were used again; the longest ones go in any case."""
        short = np.fromiter(map(len, self.places), np.int64, len(self.places)) <= LONGEST
        again = np.flatnonzero((self.uses > 1) & short)
        again = again[again >= self.n_special]
        if len(again) > REMEMBERED:
            again = np.sort(again[np.argpartition(-self.uses[again], REMEMBERED)[:REMEMBERED]])
        kept = np.concatenate([np.arange(self.n_special), again])
        keys = list(self.places)
        ids = [self._known(k) for k in kept.tolist()]
        uses = self.uses[kept] // 2
        self.places, self.held = Places([keys[k] for k in kept.tolist()]), 0
        self.flat, self.starts, self.sizes, self.uses = self.flat[:0], self.starts[:0], self.sizes[:0], self.uses[:0]
        self._append(ids)
        self.uses = uses

    def _known(self, place: int) -> bytes:
        a = self.starts[place]
        return self.flat[a : a + self.sizes[place]].tobytes()

    def _learn(self) -> None:
        """Enter the ids of new parts, and of their words in small letters."""
        new, self.places.new = self.places.new, []
        self.held += sum(map(len, new))
        whole, words, others = self.word.fullmatch, set(), set()
        if self.folds:
            pieces = []
            for part in new:
                p = part.decode()
                if whole(p):
                    p = p.lower()
                    words.add(p)
                    pieces.append((p,))
                    continue
                some = []
                for q in self.parts.findall(p):
                    if whole(q):
                        q = q.lower()
                        words.add(q)
                    else:
                        others.add(q)
                    some.append(q)
                pieces.append(some)
        else:
            pieces = [(p,) for p in new]
            for p in new:
                (words if whole(p) else others).add(p)
        found: dict[str, bytes] = {}
        known, get = len(self.starts), self.places.get
        if self.folds:
            for p in chain(words, others):
                place = get(p.encode(), known)
                if place < known:
                    found[p] = self._known(place)
            words.difference_update(found)
            others.difference_update(found)
        odd = [p for p in words if len(p) > LONGEST] + [p for p in others if len(p) > LONGEST or "<|" in p]
        words.difference_update(odd)
        others.difference_update(odd)
        if odd:
            for p, e in zip(odd, self.plain.encode_batch_fast(odd, add_special_tokens=False)):
                found[p] = np.array(e.ids, "<u4").tobytes()
        self._joined(list(words), "" if self.spaced else " ", found, self.cutter)
        self._joined(list(others), SEPARATOR, found, self.joined)
        ids = [found[p[0]] if len(p) == 1 else b"".join([found[q] for q in p]) for p in pieces]
        if self.folds:
            for p in chain(words, others):
                part = p.encode()
                if part not in self.places:
                    self.places[part] = len(self.places)
                    ids.append(found[p])
        self._append(ids)

    def _joined(self, parts: list[str], glue: str, out: dict[str, bytes], by) -> None:
        """Encode many parts as one string and cut its ids at separators or edges of words."""
        strings = [glue.join(parts[i : i + JOINED]) for i in range(0, len(parts), JOINED)]
        for k, e in enumerate(by.encode_batch_fast(strings, add_special_tokens=False)):
            some = parts[k * JOINED : (k + 1) * JOINED]
            ids = np.array(e.ids, "<u4")
            if glue == SEPARATOR:
                ends = np.append(np.flatnonzero(ids == self.separator), len(ids))
                begins = np.append(0, ends[:-1] + 1)
            elif self.spaced:
                begins = np.flatnonzero(self.edge[ids])
                ends = np.append(begins[1:], len(ids))
            else:
                ends = np.flatnonzero(self.edge[ids]) + 1
                begins = np.append(0, ends[:-1])
            if len(ends) != len(some):
                raise ValueError("the tokenizer merged across the edge of a part")
            raw = ids.tobytes()
            out.update(zip(some, [raw[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist())]))


def encoder(path: str, parts: re.Pattern, folds: bool = False) -> PartEncoder:
    """The worker's encoder of that file, kept between tasks."""
    return worker_cache((path, parts.pattern, folds), lambda: PartEncoder(path, parts, folds))
