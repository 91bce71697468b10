"""Counting the hits of a large lexicon in one pass over a text.

A text is cut into its words once, and those are looked up in a table of the forms that are one
word, with their endings. For the other forms an Aho-Corasick automaton finds every place at once;
word boundaries and endings are then looked at in the text around it. The cost is that of the text
and its hits, whatever the number of keywords. The counts are those of the patterns of
:mod:`plenumlens.functions.keywords`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from hashlib import md5
from unicodedata import category

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from plenumlens.functions.keywords import SUFFIXES, Keyword, first_weights, plain_form
from plenumlens.functions.text import drop_marks

MATCHES = "array<struct<ord:int,keyword:string,count:int,weight:double>>"
#: Words in the table of a lexicon, at most: its one-word forms, each alone and with every ending.
TABLE_WORDS = 1 << 18

_MATCH = pa.struct([("ord", pa.int32()), ("keyword", pa.string()), ("count", pa.int32()), ("weight", pa.float64())])


class _WordCharacters(dict):
    """Whether a character is a letter, number or underscore."""

    def __missing__(self, c: str) -> bool:
        found = self[c] = c == "_" or category(c)[0] in "LN"
        return found


_is_word = _WordCharacters().__getitem__


def _word_like(c: str) -> bool:
    """How the patterns look at the ends of a form."""
    return c.isalnum() or c == "_"


class KeywordAutomaton:
    """Counts of written forms in texts; ``endings`` may follow a form, the first that fits counts."""

    def __init__(self, forms: Sequence[str], endings: Sequence[str] = ()):
        self._machine = ahocorasick.Automaton()
        for i, form in enumerate(forms):
            if form:
                self._machine.add_word(form, (i, len(form), _word_like(form[0]), _word_like(form[-1])))
        if len(self._machine):
            self._machine.make_automaton()
        self._endings = tuple(endings)

    def counts(self, text: str | None) -> dict[int, int]:
        """Hits by the form's place; hits of one form do not overlap."""
        found: dict[int, int] = {}
        if not text or not len(self._machine):
            return found
        free: dict[int, int] = {}  # where the next hit of a form may begin
        n = len(text)
        for last, (form, size, word_first, word_last) in self._machine.iter(text):
            first = last + 1 - size
            if first < free.get(form, 0):
                continue
            if (first > 0 and _is_word(text[first - 1])) == word_first:
                continue
            end = last + 1
            for ending in self._endings:
                stop = end + len(ending)
                if text.startswith(ending, end) and not (stop < n and _is_word(text[stop])):
                    end = stop
                    break
            else:
                if (end < n and _is_word(text[end])) == word_last:
                    continue
            found[form] = found.get(form, 0) + 1
            free[form] = end
        return found


#: The words of a text: runs of the characters for which _is_word holds.
_words_of = re.compile(r"\w+").findall


def _table_forms(forms: Sequence[str], endings: Sequence[str], most: int) -> list[int]:
    """Places of the forms that are looked up as words: all that are one word, unless there are too many."""
    if any("".join(_words_of(e)) != e for e in endings):
        return []  # an ending that is more than a part of a word
    single = [i for i, form in enumerate(forms) if _words_of(form) == [form]]
    return single if len(single) * (1 + len(endings)) <= most else []


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions first, first + 1... of runs of the given sizes, one after the other."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class _Lists:
    """Short lists of numbers in one array; each number of ``at`` is replaced by the members of its list."""

    def __init__(self, lists: Sequence[Sequence[int]]):
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.members = np.array([m for x in lists for m in x], np.int64)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members, and how many each number has."""
        sizes = self.sizes[at]
        return self.members[_runs(self.first[at], sizes)], sizes


class _FormCounter:
    """Counts of written forms in many texts, by a table of words and an automaton for the other forms."""

    def __init__(self, forms: Sequence[str], endings: Sequence[str], table: Sequence[int]):
        self.n_forms = max(1, len(forms))
        held: dict[str, list[int]] = {}
        for i in table:
            for word in dict.fromkeys([forms[i], *(forms[i] + e for e in endings)]):
                held.setdefault(word, []).append(i)
        self.word = {word: k for k, word in enumerate(held, 1)}
        self.forms = _Lists([(), *held.values()])
        looked_up = set(table)
        others = ["" if i in looked_up else form for i, form in enumerate(forms)]
        self.automaton = KeywordAutomaton(others, endings) if any(others) else None

    def counts(self, texts: Sequence[str | None], words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, form and count of all hits, by text and form; ``words`` are those of the table, ``sizes`` their number in each text."""
        form, n = self.forms.of(words)
        text = np.repeat(np.repeat(np.arange(len(sizes)), sizes), n)
        key, count = np.unique(text * self.n_forms + form, return_counts=True)
        if self.automaton is not None:
            more = [(i * self.n_forms + form, n) for i, t in enumerate(texts) for form, n in self.automaton.counts(t).items()]
            found = np.array(more, np.int64).reshape(-1, 2)
            key, count = np.concatenate([key, found[:, 0]]), np.concatenate([count, found[:, 1]])
            order = np.argsort(key)
            key, count = key[order], count[order]
        return key // self.n_forms, key % self.n_forms, count


#: Counters of this worker by the digest of what they hold; the latest few stay for its next tasks.
_built: dict[str, _FormCounter] = {}
_KEPT = 8


class Counter:
    """Counts a lexicon's hits, in lexicon order; sent to the tasks as its entries only."""

    def __init__(self, lexicon: Sequence[Keyword], lenient: bool, suffixes: Sequence[str] = SUFFIXES, table_words: int = TABLE_WORDS):
        self.entries = list(lexicon) if lenient else first_weights(lexicon)
        written = [plain_form(k.keyword) if lenient else k.keyword.lower() for k in self.entries]
        self.forms = tuple(dict.fromkeys(written))
        at = {form: i for i, form in enumerate(self.forms)}
        of_form: list[list[int]] = [[] for _ in self.forms]
        for entry, form in enumerate(written):
            of_form[at[form]].append(entry)
        self.of_form = _Lists(of_form)
        self.endings = tuple(suffixes) if lenient else ()
        self.table = _table_forms(self.forms, self.endings, table_words)
        self.digest = md5(json.dumps([self.forms, self.endings, table_words]).encode()).hexdigest()
        self.lenient = lenient
        self.ords = pa.array([k.ord for k in self.entries], pa.int32())
        self.keywords = pa.array([k.keyword for k in self.entries], pa.string())
        self.weights = pa.array([float(k.weight) for k in self.entries], pa.float64())

    def others(self) -> list[Keyword]:
        """The entries that are not looked up as words: a hit of theirs may reach over the end of a segment."""
        entries, _ = self.of_form.of(np.array(sorted({*range(len(self.forms))} - {*self.table}), np.int64))
        return [self.entries[e] for e in sorted(entries.tolist())]

    def forms_counter(self) -> _FormCounter:
        if self.digest not in _built:
            while len(_built) >= _KEPT:
                del _built[next(iter(_built))]
            _built[self.digest] = _FormCounter(self.forms, self.endings, self.table)
        return _built[self.digest]

    def counts(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, entry and count of all hits, by text and entry."""
        return _counts(texts, self)[0]

    def of_forms(self, text: np.ndarray, form: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entry, n = self.of_form.of(form)
        text, count = np.repeat(text, n), np.repeat(count, n)
        order = np.lexsort([entry, text])
        return text[order], entry[order], count[order]

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(entry, count) of each entry that the text hits, in lexicon order."""
        _, entry, count = self.counts([text])
        return [*zip(entry.tolist(), count.tolist())]

    def lists(self, n_texts: int, text: np.ndarray, entry: np.ndarray, count: np.ndarray) -> pa.ListArray:
        """The hits as one list a text."""
        at = pa.array(entry, pa.int64())
        structs = pa.StructArray.from_arrays(
            [self.ords.take(at), self.keywords.take(at), pa.array(count, pa.int32()), self.weights.take(at)], fields=list(_MATCH))
        return _lists(np.bincount(text, minlength=n_texts), structs)

    def of_texts(self, texts: Sequence[str | None]) -> pa.ListArray:
        return self.lists(len(texts), *self.counts(texts))


def _counts(texts: Sequence[str | None], *counters: Counter) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, entry and count of all hits of each counter; a text is cut into words once for all of them."""
    of_forms = [c.forms_counter() for c in counters]
    known = [([], np.zeros(len(texts), np.int64), f.word.get, c.lenient) for c, f in zip(counters, of_forms) if f.word]
    bare = any(c.lenient for c in counters)
    for i, text in enumerate(texts if known else ()):
        if not text:
            continue
        words = plain = _words_of(text)
        if bare and (unmarked := drop_marks(text)) != text:
            plain = _words_of(unmarked)
        for held, sizes, number, lenient in known:
            hit = [*filter(None, map(number, plain if lenient else words))]
            if hit:
                held += hit
                sizes[i] = len(hit)
    found = iter(known)
    none = ([], np.zeros(len(texts), np.int64))
    counts = []
    for c, f in zip(counters, of_forms):
        held, sizes = next(found)[:2] if f.word else none
        read = [t and drop_marks(t) for t in texts] if c.lenient and f.automaton is not None else texts
        counts.append(c.of_forms(*f.counts(read, np.array(held, np.int64), sizes)))
    return counts


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    """Members of each list; null has none."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _each_of(counter: Counter):
    def count(texts: pa.Array) -> pa.Array:
        return counter.of_texts(texts.to_pylist())

    return count


def _each_list_of(counter: Counter):
    def count(lists: pa.Array) -> pa.Array:
        return _lists(_sizes(lists), counter.of_texts(lists.flatten().to_pylist()))

    return count


def _places(lenient: Counter, group: np.ndarray, number: dict[str, int], text: np.ndarray, entry: np.ndarray, count: np.ndarray):
    """(group, keyword number) of each group's distinct keywords as a sorted key, and their places from 0 on.

    The order is that of :func:`plenumlens.operators.fragments.keyword_order`: best-scored text first, then that of the lexicon.
    """
    weight = lenient.weights.to_numpy()
    score = np.bincount(text, count * weight[entry], len(group))
    order = np.lexsort([entry, text, -score[text], group[text]])
    keyword = np.array([number[k.keyword] for k in lenient.entries], np.int64)
    key, first = np.unique(group[text[order]] * len(number) + keyword[entry[order]], return_index=True)
    place = np.empty(len(key), np.int64)
    seen = np.argsort(first)  # groups one after the other
    place[seen] = np.arange(len(key))
    return key, place - np.searchsorted(key // len(number), key // len(number))


def _around(is_hit: np.ndarray, width: int, group: np.ndarray, n_entries: int, text: np.ndarray, entry: np.ndarray, count: np.ndarray):
    """The hits in each chosen text and up to ``width`` texts of its group on either side."""
    keys, counts = [], []
    for step in range(-width, width + 1):
        at = text + step
        kept = (at >= 0) & (at < len(group))
        kept[kept] = is_hit[at[kept]] & (group[at[kept]] == group[text[kept]])
        keys.append(at[kept] * n_entries + entry[kept])
        counts.append(count[kept])
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)
    return key // n_entries, key % n_entries, total


def _windows_of(lenient: Counter, strict: Counter, width: int):
    number = {k: i for i, k in enumerate(dict.fromkeys(e.keyword for e in lenient.entries))}
    others = {*strict.others()}
    across = np.array([e in others for e in strict.entries])
    keyword = np.array([number[e.keyword] for e in strict.entries], np.int64)
    names = pa.array([*number], pa.string())

    def count(segments: pa.Array) -> pa.Array:
        texts, sizes = segments.flatten().to_pylist(), _sizes(segments)
        n = len(texts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        loose, (text, entry, hits) = _counts(texts, lenient, strict)
        key, place = _places(lenient, group, number, *loose)

        def listed(text: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Whether the keyword is one of the group, and its place."""
            wanted = group[text] * len(number) + keyword[entry]
            at = np.searchsorted(key, wanted)
            found = np.append(key, -1)[at] == wanted
            return found, np.append(place, 0)[at]

        known, _ = listed(text, entry)
        is_hit = np.zeros(n, bool)
        is_hit[text[known]] = True
        single = known & ~across[entry]
        near = _around(is_hit, width, group, len(strict.entries), text[single], entry[single], hits[single])
        order = np.lexsort([listed(*near[:2])[1], near[0]])
        windows = strict.lists(n, *(x[order] for x in near))
        by_place = np.lexsort([place, key // len(number)])
        keywords = names.take(pa.array(key[by_place] % len(number), pa.int64()))
        return pa.StructArray.from_arrays(
            [_lists(np.bincount(key // len(number), minlength=len(sizes)), keywords),
             _lists(sizes, pa.array(is_hit)), _lists(sizes, windows)], ["keywords", "hit", "near"])

    return count


def text_matches(text: Column, lexicon: Sequence[Keyword], lenient: bool = False, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The hits in a text, as ``strict_matches`` or ``lenient_matches`` have them; null has none."""
    source = F.lower(text) if lenient else text
    return F.arrow_udf(_each_of(Counter(lexicon, lenient, suffixes)), MATCHES)(source)


def list_matches(texts: Column, lexicon: Sequence[Keyword], lenient: bool = False, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The hits in each text of an array."""
    source = F.transform(texts, F.lower) if lenient else texts
    return F.arrow_udf(_each_list_of(Counter(lexicon, lenient, suffixes)), f"array<{MATCHES}>")(source)


def window_matches(segments: Column, lexicon: Sequence[Keyword], width: int, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """A statement's ``keywords`` in order, the segments that are ``hit``, and the matches ``near`` each of these.

    ``segments`` is the array of the segments' texts, in lower case. ``keywords`` are those of the
    lenient hits, best-scored segment first; a segment is hit if one of them is in it strictly.
    ``near`` are the strict matches of such keywords in a hit segment and ``width`` neighbours on
    each side, in the order of the keywords: the sums over these segments, since no word reaches
    over the end of one. It has no match of the entries of :func:`across_segments`.
    """
    count = _windows_of(Counter(lexicon, True, suffixes), Counter(lexicon, False), width)
    return F.arrow_udf(count, f"struct<keywords:array<string>,hit:array<boolean>,near:array<{MATCHES}>>")(segments)


def across_segments(lexicon: Sequence[Keyword]) -> list[Keyword]:
    """The entries that are not looked up as words: their strict matches may reach over the end of a segment."""
    return Counter(lexicon, False).others()
