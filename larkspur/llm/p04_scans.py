"""Problem 4: noise in text from scanned pages.

One pass over all texts counts words and word pairs; the frequent ones (a share of all words, so a bounded number)
make the vocabulary. Page furniture (running heads and feet, page numbers) is found by its place at page borders, its
repetition and its counting up; words cut at line ends are rejoined and told from compounds by the vocabulary;
every other unknown word is looked up by intersecting a Levenshtein automaton, in which the confusions of character
recognition are cheaper edits, with a trie of the vocabulary. That yields all candidates within a given cost, for all
words of a batch together; context ranks them. Repaired text has no furniture and continuous paragraphs.

Defined results: null and empty texts have no noise and come out empty; rows with a null id are left out; repeated
rows count once. Texts without signs of scanning (no page numbers, no lines broken inside sentences) stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.text import lower
from larkspur.session import cut

#: A word or word pair belongs to the vocabulary from this share of all words (so at most 1 / SHARE entries).
SHARE = 1e-6
#: The halves of a compound broken at its own hyphen have more than this share of all words each.
COMPOUND_SHARE = 9e-5
#: A frequent word is itself a misreading where a candidate is so many times more frequent.
RATIO = 25
#: Pages in a row whose number may be missing in a sequence of page numbers.
MOST_MISSED = 3
#: Cost of an edit (a letter seen wrongly, one too many or one too few), of a listed confusion, and what a misreading of a
#: word of more than four letters costs at most (two confusions or one edit; one confusion in shorter words).
EDIT = 10
CONFUSED = 7
MOST = 14
#: Words that are looked up together.
BLOCK = 2048
# What character recognition takes for what (seen, meant).
CONFUSIONS = (
    "0 o|1 l|1 i|5 s|8 b|6 b|6 g|9 g|9 q|2 z|3 e|4 a|7 t|l i|i l|o a|a o|e c|c e|b h|h b|n u|u n|v y|f t|t f|q g|g q|i j|j i|o 0|l 1|s 5|"
    "ii u|li h|rn m|m rn|cl d|d cl|vv w|w vv|ri n|nn m|in m|ni m|u ii|h li|lc k|tl d|ct d|o e|e o|c o|o c|l t|t l|r n|a e|e a|i t"
)
HYPHENS = "-­‐‑¬"
_HYPHENS = frozenset(HYPHENS)
#: Marks the shapes of heads and feet among the counted keys; those of so many texts, however many texts there are, are
#: looked for in all texts.
HEAD = "\x01"
LEAST_TEXTS = 3

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_CUT = re.compile(rf"([^\W\d_]+)([{HYPHENS}])\s*\Z")
_FIRST = re.compile(r"\s*([^\W_]+)")
_NUMBERED = re.compile(r"^\s*(?:(?P<open>[\[(–—-]\s*)?(?P<word>page|pg\.?|p\.?|seite|página|पृष्ठ)?\s*(?P<n>\d{1,4})(?P<of>\s*(?:of|/|von|de)\s*\d{1,4})?\s*(?P<close>[\])–—-])?)\s*$", re.I)
_ROMAN = re.compile(r"^\s*[\[(–-]?\s*([ivxlc]{1,8})\s*[\])–-]?\s*$")
# Letters that stand for digits, and numbers of which some digits were seen as letters.
_DIGITS = str.maketrans("OoQDlIi|SsBZzqg", "000011115582299")
_MISNUMBERED = re.compile(_NUMBERED.pattern.replace(r"\d", r"[\dOoQDlIi|SsBZzqg]"), re.I)
_MISNUMBER = re.compile(r"(?<![\w.,/-])(?=[OolI]*\d)(?=\d*[OolI])[\dOolI]{2,}(?![\w/])(?!-\w)")
_ENDS = frozenset(".!?।:;")
_YEAR_OR_NUMBER = re.compile(r"(?:19|20|2O)[\dOolI]{2}\b|[|·–—-]\s*\d{1,4}\s*$|^\s*\d{1,4}\s*[|·–—-]\s")


class Trie:
    """Vocabulary as a trie in flat arrays: arc i leads to node i + 1, and arcs are sorted by (node, letter)."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        codes = _codes("".join(self.words))
        starts = np.cumsum(sizes) - sizes
        at, left = np.zeros(len(self.words), np.int64), np.arange(len(self.words))
        arcs, n, depth = [np.empty(0, np.int64)], 0, 0
        ends = {}
        while len(left):
            done = sizes[left] == depth
            ends |= dict(zip(at[done].tolist(), left[done].tolist()))
            left, at = left[~done], at[~done]
            key = at << _LETTER | codes[starts[left] + depth]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            arcs.append(key[new])
            at = n + np.cumsum(new)
            n += int(new.sum())
            depth += 1
        self.arcs = np.concatenate(arcs)
        self.first = np.searchsorted(self.arcs, np.arange(n + 2) << _LETTER)
        self.end = np.full(n + 1, -1, np.int64)
        self.end[list(ends)] = list(ends.values())

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node behind the arc of a letter, -1 where there is none."""
        if not len(self.arcs):
            return np.full(len(node), -1, np.int64)
        key = node << _LETTER | letter
        i = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
        return np.where((self.arcs[i] == key) & (node >= 0), i + 1, -1)

    def within(self, seen: list[str], most: list[int]) -> list[list[tuple[int, str]]]:
        """For each word of ``seen`` (cost, word) of every vocabulary word from which it arises by edits of at most ``most``.

        An edit is a letter seen wrongly, one too many or one too few (cost EDIT), or a listed confusion (cost CONFUSED).
        A state of the automaton is (word, node, place in the word, cost); all states of all words move down the trie
        together, one arc a round.
        """
        sizes = np.fromiter(map(len, seen), np.int64, len(seen))
        budget = np.asarray(most, np.int64)
        codes = _codes("\0".join(seen) + "\0")
        start = np.cumsum(sizes + 1) - sizes - 1
        forms, meant = _confusions(codes)
        of_place = np.searchsorted(forms[:, 0], np.arange(len(codes) + 1))
        q = np.arange(len(seen))
        state = np.stack([q, np.zeros_like(q), np.zeros_like(q), np.zeros_like(q)])
        found: list[np.ndarray] = []
        while state.shape[1]:
            while True:  # letters too many
                q, node, at, cost = state
                more = (at < sizes[q]) & (cost + EDIT <= budget[q])
                longer = _least(np.concatenate([state, np.stack([q, node, at + 1, cost + EDIT])[:, more]], axis=1))
                if longer.shape[1] == state.shape[1]:
                    break
                state = longer
            q, node, at, cost = state
            whole = (at == sizes[q]) & (self.end[node] >= 0)
            found.append(np.stack([q[whole], cost[whole], self.end[node[whole]]]))
            place = start[q] + at
            same = self.step(node, codes[place])
            moved = [np.stack([q, same, at + 1, cost])[:, (same >= 0) & (at < sizes[q])]]
            # A listed confusion, of one letter or two on either side.
            n = np.where((cost + CONFUSED <= budget[q]) & (at < sizes[q]), of_place[place + 1] - of_place[place], 0)
            i, j = np.repeat(np.arange(len(q)), n), _ranges(of_place[place], n)
            to = self.step(node[i], meant[j, 0])
            to = np.where(meant[j, 1] > 0, self.step(to, meant[j, 1]), to)
            moved.append(np.stack([q[i], to, at[i] + forms[j, 1], cost[i] + CONFUSED])[:, to >= 0])
            # Another letter, or a letter too few.
            n = np.where(cost + EDIT <= budget[q], self.first[node + 1] - self.first[node], 0)
            i, to = np.repeat(np.arange(len(q)), n), _ranges(self.first[node], n) + 1
            few = np.stack([q[i], to, at[i], cost[i] + EDIT])
            moved += [few, (few + np.array([[0], [0], [1], [0]]))[:, at[i] < sizes[q[i]]]]
            state = _least(np.concatenate(moved, axis=1))
        out: list[dict[str, int]] = [{} for _ in seen]
        for i, c, w in np.concatenate(found, axis=1).T.tolist():
            out[i][self.words[w]] = min(c, out[i].get(self.words[w], c))
        return [[(c, w) for w, c in own.items()] for own in out]


_LETTER = 21


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every row, ``n`` numbers each, one row after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _least(state: np.ndarray) -> np.ndarray:
    """Of states that differ in their cost alone the cheapest."""
    order = np.lexsort(state[::-1])
    state = state[:, order]
    new = np.ones(state.shape[1], bool)
    new[1:] = (state[:3, 1:] != state[:3, :-1]).any(0)
    return state[:, new]


def _confusions(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, letters seen) and (letters meant, 0 for none) of every listed confusion in a text, in order of places."""
    after = np.append(codes[1:], 0)
    rows = []
    for pair in CONFUSIONS.split("|"):
        seen, meant = (_codes(x) for x in pair.split(" "))
        hit = codes == seen[0]
        if len(seen) > 1:
            hit &= after == seen[1]
        at = np.flatnonzero(hit)
        rows.append(np.stack([at, np.full_like(at, len(seen)), np.full_like(at, meant[0]), np.full_like(at, meant[1] if len(meant) > 1 else 0)], axis=1))
    all_ = np.concatenate(rows)
    all_ = all_[np.argsort(all_[:, 0], kind="stable")]
    return all_[:, :2], all_[:, 2:]


class Vocabulary:
    """Frequent words and pairs of the corpus and the search for what a misread word means.

    Every threshold is a share of all words or a ratio of two counts: a text gets the same result whether its corpus is
    counted once or a thousand times. ``total``: all words of the corpus, rare ones included.
    """

    def __init__(self, counts: dict[str, int], pairs: dict[tuple[str, str], int], total: int | None = None):
        total = sum(counts.values()) if total is None else total
        self.counts, self.pairs, self.known = counts, pairs, {}
        self.least, self.usual = max(SHARE * total, min(counts.values(), default=1)), COMPOUND_SHARE * total
        self.trie = Trie([w for w in counts if w.isalpha()])
        self.top = max((counts[w] for w in self.trie.words), default=0)
        #: Words that nothing is RATIO times more frequent than, or that were looked up in vain: they are right.
        self.right = {w for w in self.trie.words if counts[w] * RATIO > self.top}

    def look_up(self, words: list[str]) -> None:
        """Searches the candidates of several words at once."""
        new = [w for w in dict.fromkeys(words) if w not in self.known and w not in self.right]
        if len(self.known) > 500_000:
            self.right -= self.known.keys()
            self.known.clear()
        for i in range(0, len(new), BLOCK):
            part = new[i : i + BLOCK]
            for word, near in zip(part, self.trie.within(part, [MOST if len(w) > 4 else CONFUSED for w in part])):
                own = self.counts.get(word, 0)
                needed = own * (RATIO if word.isalpha() else 2)
                # Any other edit may also make a rare word out of a word, so its candidate must be frequent beside unknown words, too.
                sure = max(needed, RATIO * max(own, self.least))
                self.known[word] = [(c, w) for c, w in near if w != word and self.counts[w] >= (needed if c % EDIT else sure)]
                if not self.known[word]:
                    self.right.add(word)

    def meant(self, word: str, before: str | None = None, after: str | None = None) -> str | None:
        """The word that a misread ``word`` stands for; None if it is right or nothing fits."""
        if word in self.right:
            return None
        if word not in self.known:
            self.look_up([word])
        found = self.known[word]
        if not found:
            return None
        least = min(c for c, _ in found)
        near = [w for c, w in found if c == least]
        return max(near, key=lambda w: (self.pairs.get((before, w), 0) + self.pairs.get((w, after), 0), self.counts[w], w))

    def is_cut(self, left: str, right: str) -> bool:
        """Whether left-right is one word that was cut, not a compound broken at its own hyphen."""
        joined, compound = left + right, f"{left}-{right}"
        one, two = self.counts.get(joined, 0), self.counts.get(compound, 0)
        if one or two:
            return one >= two
        if not right.isalpha() or len(left) < 2:
            return False
        if self.meant(joined):
            return True
        parts = right.split("-")[0]
        return not (self.counts.get(left, 0) > self.usual and (self.counts.get(parts, 0) > self.usual or (self.meant(parts) is not None and len(left) > 2)))


def _ends(line: str) -> bool:
    """Whether a line ends like a sentence."""
    return line.rstrip().rstrip("\"')]")[-1:] in _ENDS


def _cut_word(line: str) -> re.Match | None:
    return _CUT.search(line) if line.rstrip()[-1:] in _HYPHENS else None


def tokens(line: str) -> list[tuple[str, int, int]]:
    """Lower-case words with their places; parts of codes and numbers are left out."""
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(lower(line))]


_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+(?:-[^\W\d_]+)*")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    pairs: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = [*counts, *map(" ".join, pairs)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([*counts.values(), *pairs.values()], pa.int64())], ["key", "n"])

    for b in batches:
        for text in b["text"].to_pylist():
            low = lower(text)
            found = _TOKEN.findall(low)
            counts.update(found)
            pairs.update(zip(found, found[1:]))
            counts.update(_COMPOUND.findall(low))
            lines = text.split("\n")
            counts.update({HEAD + _shape(lines[i]) for i, kind in furniture(lines).items() if kind == "header"})
        if len(counts) + len(pairs) > 400_000:
            yield flush()
            counts, pairs = Counter(), Counter()
    if counts:
        yield flush()


def _counted(texts: DataFrame) -> tuple[DataFrame, int]:
    """(key, n of frequent words and pairs and of shapes of heads in all texts; number of all words)."""
    texts = texts.where(F.length("text") > 0)
    total = texts.agg(F.sum(F.regexp_count("text", F.lit(r"(?U)[^\W_]+(?:['’][^\W_]+)?")))).first()[0] or 0
    counted = texts.mapInArrow(_count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    least = F.when(F.startswith("key", F.lit(HEAD)), LEAST_TEXTS).otherwise(F.lit(SHARE * total))
    return cut(counted.where(F.col("n") >= least)), total


def _frequent(counted: DataFrame, total: int) -> Vocabulary:
    words: dict[str, int] = {}
    pairs: dict[tuple[str, str], int] = {}
    for r in counted.where(~F.startswith("key", F.lit(HEAD))).toLocalIterator():
        if " " in r["key"]:
            a, _, c = r["key"].partition(" ")
            pairs[a, c] = r["n"]
        else:
            words[r["key"]] = r["n"]
    return Vocabulary(words, pairs, total)


def vocabulary(texts: DataFrame) -> Vocabulary:
    """``texts``: text. Counts over all texts; the driver receives at most 1 / SHARE words and pairs."""
    return _frequent(*_counted(texts))


def _border_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(run_id, shape) for run_id, text in zip(b["run_id"].to_pylist(), b["text"].to_pylist()) for shape in border_shapes([x.rstrip("\r") for x in text.split("\n")])]
        columns = list(zip(*rows)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["run_id", "shape"])


def border_shapes(lines: list[str]) -> set[str]:
    """Shapes of the lines that may be heads or feet: at page borders, or next to page numbers there."""
    text = [bool(x.strip()) for x in lines] + [False]  # the last is the one before the first, too
    out: set[str] = set()
    for i in range(len(lines)):
        for step in (1, -1):
            j = i
            if not text[i] or text[i - step]:
                continue
            out.add(_shape(lines[j]))
            while _looks_numbered(lines[j]) and text[j + step]:
                j += step
                out.add(_shape(lines[j]))
    return out - {""}


def _looks_numbered(line: str) -> bool:
    return bool(_NUMBERED.match(line) or _ROMAN.match(line) or _misread_number(line))


def _with_heads(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """run_id, text and the shapes among its own that other texts have shown to be heads; no list of all heads is sent."""
    heads = counted.where(F.startswith("key", F.lit(HEAD)) & (F.col("n") >= LEAST_TEXTS)).select(F.expr("substring(key, 2)").alias("shape"))
    own = rows.mapInArrow(_border_shapes, "run_id string, shape string").distinct().join(heads, "shape").groupBy("run_id").agg(F.collect_set("shape").alias("heads"))
    return rows.join(own, "run_id", "left")


_COUNTED = re.compile(r"[\d|]+(?:[a-z](?![^\W\d_]))?")
_MARKS = re.compile(r"[^\w#]+")


@lru_cache(100_000)
def _shape(line: str) -> str:
    """A line without what changes from page to page and what recognition confuses."""
    return _MARKS.sub(" ", _COUNTED.sub("#", lower(line))).strip(" #")


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 4 or min(len(a), len(b)) < 5:
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.quick_ratio() >= 0.86 and m.ratio() >= 0.86


def _titled(line: str) -> bool:
    """Whether a line looks like a head: few words, no sentence, most of them with capitals."""
    found = _TOKEN.findall(line)
    if not 1 <= len(found) <= 10 or len(line.strip()) > 70 or _ends(line):
        return False
    return line.strip()[:1].isupper() or line.strip()[:1].isdigit()


def _roman(text: str) -> int | None:
    value, last = 0, 0
    for c in reversed(text.lower()):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c]
        value, last = (value - v, last) if v < last else (value + v, v)
    return value if 0 < value < 200 else None


def _misread_number(line: str) -> tuple[int, bool, bool] | None:
    """Number of a page number with misread digits, whether its notation can be nothing else, and whether it holds a digit."""
    m = _MISNUMBERED.match(line)
    if not m or line.strip().endswith("."):
        return None
    n = m["n"].translate(_DIGITS)
    return (int(n), bool(m["word"] or m["of"] or m["open"] and m["close"]), any(map(str.isdigit, line))) if n.isdigit() else None


def _chain(numbers: list[tuple[int, int]]) -> list[int]:
    """The lines of the longest chain of numbers that count up; pages whose number wasn't recognised leave gaps."""
    chains: dict[int, tuple[list[int], bool]] = {}
    best: list[int] = []
    for i, v in numbers:
        before, gap = max(((chains[v - k], k) for k in range(1, MOST_MISSED + 2) if v - k in chains), key=lambda x: (len(x[0][0]), -x[1]), default=(([], True), 1))
        chain, tight = [*before[0], i], before[1] and gap == 1
        if v not in chains or len(chain) >= len(chains[v][0]):
            chains[v] = chain, tight
        if len(chain) > len(best) and (len(chain) > 2 or tight):
            best = chain
    return best


def furniture(lines: list[str], heads: frozenset[str] = frozenset()) -> dict[int, str]:
    """``header`` or ``page_number`` by line index.

    Page borders are blank lines (or the ends of the text). A line at a border is a page number if its notation can be
    nothing else, or if plain numbers at borders count up one by one. Heads and feet stand at borders, next to page
    numbers or where a sentence goes on behind the border, and come back in the same shape, carry a year or page number, or
    have a shape of ``heads``, which other texts have shown to be one.
    """
    n = len(lines)
    blank = [not x.strip() for x in lines]
    found: dict[int, str] = {}
    text = [i for i in range(n) if not blank[i]]
    if not text:
        return found
    ends = [i for i in text if i + 1 >= n or blank[i + 1]]
    starts = [i for i in text if i == 0 or blank[i - 1]]
    # Page numbers.
    plain: list[tuple[int, int]] = []
    romans: list[tuple[int, int]] = []
    marked: list[tuple[int, int]] = []
    misread: list[tuple[int, int]] = []
    for i in sorted({*ends, *starts}):
        m = _NUMBERED.match(lines[i])
        if m:
            if m["word"] or m["of"] or m["open"] and m["close"]:
                found[i] = "page_number"
                marked.append((i, int(m["n"])))
            elif not lines[i].strip().endswith("."):
                plain.append((i, int(m["n"])))
            continue
        if (m := _ROMAN.match(lines[i])) and (v := _roman(m[1])):
            romans.append((i, v))
        if w := _misread_number(lines[i]):
            misread.append((i, w[0]))
            if w[1] and w[2]:
                found[i] = "page_number"
                marked.append(misread.pop())
    for numbers in (plain, romans):
        best = _chain(numbers)
        if len(best) >= 2:
            found |= dict.fromkeys(best, "page_number")
    if misread:
        # Misread numbers that count up together with at least as many well read ones, all of the chain among them.
        read = {*(i for i, _ in plain), *(i for i, _ in marked)}
        for numbers in (plain, marked):
            best = _chain(sorted([*numbers, *misread]))
            if len(best) >= 2 and set(_chain(numbers)) <= set(best) and 2 * len(read & set(best)) >= len(best):
                found |= dict.fromkeys(best, "page_number")
    if not found:
        # A single page: a last line that is a small number under a foot or a sentence, not under other numbers.
        i = text[-1]
        above = lines[text[-2]] if len(text) > 1 else ""
        single = [x for x in (*plain, *romans) if x[0] == i and x[1] < 1000]
        if single and not _NUMBERED.match(above) and not re.match(r"^\s*[\d.,%₹ ]+(?:per cent)?\s*$", above) and (_ends(above) or not _titled(above) or len(above.split()) > 4 or _FOOT.search(above)):
            found[i] = "page_number"
    # Heads and feet.
    tops, bottoms, borders = {text[0]}, set(), {}
    for i in starts:
        j = i
        while j in found and j + 1 < n and not blank[j + 1]:
            j += 1
        if j not in found:
            borders[j] = "head"
            above = max((k for k in text if k < i), default=-1)
            if j > i or above in found:
                tops.add(j)
    for i in ends:
        j = i
        while j in found and j > 0 and not blank[j - 1]:
            j -= 1
        if j not in found and j not in borders:
            borders[j] = "foot"
            if i in found:
                bottoms.add(j)
    groups: list[list[int]] = []
    for i in borders:
        if len(lines[i].strip()) > 70 or not _shape(lines[i]) or (not _titled(lines[i]) if borders[i] == "head" else lines[i].lstrip()[:1].islower()):
            continue
        for g in groups:
            if borders[g[0]] == borders[i] and _alike(_shape(lines[i]), _shape(lines[g[0]])):
                g.append(i)
                break
        else:
            groups.append([i])
    for g in groups:
        known = any(_shape(lines[i]) in heads for i in g)
        if borders[g[0]] == "head":
            titled = g
            dated = sum(bool(_YEAR_OR_NUMBER.search(lines[i])) for i in titled)
            breaks = sum(_interrupts(lines, i, found) for i in titled)
            at_top = sum(i in tops for i in titled)
            if titled and (known or dated * 2 >= len(titled) and (len(titled) >= 2 or at_top or breaks) or len(titled) >= 2 and (at_top >= 2 or breaks * 2 >= len(titled))):
                found |= dict.fromkeys(titled, "header")
        else:
            upright = g
            at_bottom = sum(i in bottoms for i in upright)
            same = Counter(lines[i].strip() for i in upright if len(lines[i].split()) >= 3)
            if upright and (known or at_bottom >= 2 or max(same.values(), default=0) >= 2 or at_bottom and _FOOT.search(lines[upright[0]])):
                found |= dict.fromkeys(upright, "header")
    return found


_FOOT = re.compile(r"\brev\.? ?\d|^\W*ref\.? |not to be copied|confidential|^\W*draft\b|internal use|©|copyright|printed on|version \d", re.I)


def _interrupts(lines: list[str], i: int, found: dict[int, str]) -> bool:
    """Whether a sentence goes on across the line at a page border."""
    j = i - 1
    while j >= 0 and (not lines[j].strip() or j in found):
        j -= 1
    k = i + 1
    while k < len(lines) and (not lines[k].strip() or k in found):
        k += 1
    return j >= 0 and k < len(lines) and not _ends(lines[j]) and lines[k].lstrip()[:1].islower()


def is_scan(lines: list[str], found: dict[int, str]) -> bool:
    """Signs of scanning: page numbers, words cut at line ends, or most lines broken inside sentences."""
    if "page_number" in found.values():
        return True
    body = [x for x in lines if x.strip()]
    broken = sum(not _ends(a) and b.lstrip()[:1].islower() for a, b in zip(body, body[1:]))
    cut = sum(_cut_word(x) is not None for x in body)
    return len(body) >= 3 and (cut >= 1 and broken >= 2 or broken * 3 >= len(body))


_DIGIT = re.compile(r"\d")
_CUT_PAIR = re.compile(rf"([^\W\d_]+)[{HYPHENS}]\s*\n\s*([^\W_]+)")


def _looks_like_word(w: str) -> bool:
    """Whether something of at least three characters is written with letters, Latin ones among them."""
    if len(w) < 3 or not w.isascii() and not any("a" <= c <= "z" for c in w):
        return False
    letters = len(w) if w.isalpha() else sum(map(str.isalpha, w))
    return letters >= 2 and letters * 2 >= len(w)


class Page:
    """A text taken apart: noise by line, and what each word should be."""

    def __init__(self, text: str, heads: frozenset[str] = frozenset()):
        self.lines = text.split("\n")
        self.clean = [x.rstrip("\r") for x in self.lines]
        self.furniture = furniture(self.clean, heads)
        self.noise: list[tuple[int, str]] = []
        self.fixes: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
        self.cuts: dict[int, int] = {}
        self.scan = is_scan(self.clean, self.furniture)
        if not self.scan:
            self.furniture = {}
        self.noise += self.furniture.items()

    def unknown(self, right: set[str]) -> set[str]:
        """The words of a scanned text that may be looked up, cut words put together."""
        if not self.scan:
            return set()
        text = lower("\n".join(self.clean))
        own = set(_TOKEN.findall(text)).union(m[1] + m[2] for m in _CUT_PAIR.finditer(text)) - right
        return {w for w in own if _looks_like_word(w)}

    def read(self, vocabulary: Vocabulary) -> Page:
        """Finds cut and misread words."""
        if not self.scan:
            return self
        lines = self.clean
        body = [i for i, x in enumerate(lines) if x.strip() and i not in self.furniture]
        flagged: set[int] = set()
        skip: dict[int, int] = {}  # first place of a line that is its own word, not the rest of a cut one
        for i, j in zip(body, [*body[1:], -1]):
            line = lines[i]
            cut = _cut_word(line) if j >= 0 else None
            rest = _FIRST.match(lines[j]) if cut else None
            words_ = tokens(line)
            if cut and rest and rest[1][0].isalpha():
                left, right = lower(cut[1]), lower(rest[1])
                soft = cut[2] != "-"
                if (soft or vocabulary.is_cut(left, right)) and not (cut.start() and line[cut.start() - 1] in "-" and not soft and not vocabulary.counts.get(left + right)):
                    self.noise.append((i, "hyphen"))
                    self.cuts[i] = j
                    skip[j] = rest.end(1)
                    words_ = [t for t in words_ if t[1] != cut.start(1)]
                    meant = vocabulary.meant(left + right)
                    if meant:
                        joined = left + right
                        ops = [o for o in SequenceMatcher(None, joined, meant, autojunk=False).get_opcodes() if o[0] != "equal"]
                        for at in {i if o[1] < len(left) else j for o in ops}:
                            flagged.add(at)
                        self.fixes[i].append((cut.start(1), cut.end(), self._cased(cut[1], meant)))
                        self.fixes[j].append((rest.start(1), rest.end(1), ""))
                    else:
                        self.fixes[i].append((cut.start(2), len(line), rest[1]))
                        self.fixes[j].append((rest.start(1), rest.end(1), ""))
            start = skip.get(i, 0)
            plain = [t for t in words_ if t[1] >= start]
            for k, (w, s, e) in enumerate(plain):
                if w in vocabulary.right or not self._checked(line, w, s, e):
                    continue
                meant = vocabulary.meant(w, plain[k - 1][0] if k else None, plain[k + 1][0] if k + 1 < len(plain) else None)
                if meant:
                    flagged.add(i)
                    self.fixes[i].append((s, e, self._cased(line[s:e], meant)))
            for m in _MISNUMBER.finditer(line, start) if _DIGIT.search(line) else ():
                if all(m.end() <= s or m.start() >= e for s, e, _ in self.fixes[i]):
                    flagged.add(i)
                    self.fixes[i].append((m.start(), m.end(), m[0].translate(_DIGITS)))
        self.noise += [(i, "misread") for i in flagged]
        return self

    @staticmethod
    def _checked(line: str, w: str, s: int, e: int) -> bool:
        """Words are looked up, but not numbers, grades and parts of codes."""
        if not _looks_like_word(w):
            return False
        code = line[s:e]
        if not w.isalpha() and any(c.isdigit() for c in w) and (code.upper() == code and any(c.isupper() for c in code) and line[:s].endswith("-") or re.fullmatch(r"\d+(?:st|nd|rd|th|[a-z])", w)):
            return False
        return not re.match(r"-\d", line[e : e + 2])

    @staticmethod
    def _cased(seen: str, meant: str) -> str:
        letters = [c for c in seen if c.isalpha()]
        if len(letters) > 1 and all(c.isupper() for c in letters):
            return meant.upper()
        return meant.capitalize() if seen[:1].isupper() else meant

    def repaired(self) -> str:
        """Continuous paragraphs without furniture, cut words and misreadings."""
        if not self.scan:
            return "\n".join(self.lines)
        out: list[str] = []
        current: list[str] = []
        broken = False
        for i, raw in enumerate(self.lines):
            line = raw.rstrip("\r")
            if i in self.furniture:
                broken = True
                continue
            if not line.strip():
                # A blank line ends a paragraph, unless a page border cut a sentence there.
                if current and not broken and (_ends(current[-1]) or not self._goes_on(i)):
                    out.append(" ".join(current))
                    current = []
                continue
            for s, e, new in sorted(self.fixes.get(i, ()), reverse=True):
                line = line[:s] + new + line[e:]
            line = line.strip()
            if broken and current and _ends(current[-1]) and not self._goes_on(i - 1):
                out.append(" ".join(current))
                current = []
            broken = False
            if current and re.search(r"\w-$", current[-1]) and line[:1].isalnum():
                line = current.pop() + line  # a compound broken at its own hyphen
            if line:
                current.append(line)
        if current:
            out.append(" ".join(current))
        return "\n\n".join(re.sub(r"[ \t]+([.,;:!?)])", r"\1", re.sub(r"[ \t]+", " ", p)) for p in out)

    def _goes_on(self, i: int) -> bool:
        for k in range(i + 1, len(self.lines)):
            if self.lines[k].strip() and k not in self.furniture:
                return self.lines[k].lstrip()[:1].islower()
        return False


def pages(texts: list[str], heads: list[list[str] | None], vocabulary: Vocabulary) -> list[Page]:
    """Texts taken apart; all their unknown words are looked up at once."""
    out = [Page(t, frozenset(h or ())) for t, h in zip(texts, heads)]
    vocabulary.look_up(sorted(set().union(*(p.unknown(vocabulary.right) for p in out))))
    return [p.read(vocabulary) for p in out]


def _find(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = pages(b["text"].to_pylist(), b["heads"].to_pylist(), vocabulary.value)
            rows = [(run_id, i + 1, kind) for run_id, p in zip(b["run_id"].to_pylist(), read) for i, kind in p.noise]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()))], ["run_id", "line_no", "noise"])

    return run


def _repair(vocabulary: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = pages(b["text"].to_pylist(), b["heads"].to_pylist(), vocabulary.value)
            yield pa.RecordBatch.from_arrays([b["run_id"], pa.array([p.repaired() for p in read], pa.string())], ["run_id", "text"])

    return run


def _usable(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("run_id").isNotNull() & (F.length("text") > 0)).select("run_id", "text")


def _read(runs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """Texts with known heads, and the vocabulary: at most 1 / SHARE words and pairs, sent to each executor once."""
    rows = _usable(runs)
    counted, total = _counted(rows.select("text"))
    return _with_heads(rows, counted), rows.sparkSession.sparkContext.broadcast(_frequent(counted, total))


def noise(runs: DataFrame) -> DataFrame:
    """``runs``: run_id, text. Returns run_id, line_no (from 1), noise."""
    rows, vocabulary = _read(runs)
    return rows.mapInArrow(_find(vocabulary), "run_id string, line_no long, noise string").distinct()


def repaired(runs: DataFrame) -> DataFrame:
    """run_id and the repaired text."""
    rows, vocabulary = _read(runs)
    return rows.mapInArrow(_repair(vocabulary), "run_id string, text string")
