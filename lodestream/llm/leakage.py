"""Evaluation passages in corpus documents: SimHash of windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window whose equality counts: the shortest passage that is a leak by itself.
WINDOW = 12
#: Item-sized windows: an item and each of its halves, cut down to the next of these lengths, which grow by STEP.
SHORTEST, STEP = 18, 1.12
#: Fingerprints within so many bits are candidates. Of BLOCKS blocks one differs in RADIUS // BLOCKS bits at most, and
#: all values within so many bits of it are looked up, so that none within the radius is missed.
RADIUS, BLOCKS = 11, 4
#: Bits of a fingerprint.
BITS = 64
#: Least similarity of two item-sized windows: weighted Jaccard of their word pairs. A tenth of the words changed leaves
#: about two thirds, a sixth of them about a half.
LEAST_SIMILARITY = 0.5
#: Bytes of text that one driver-side set of test items may have; a larger set is cut into several passes.
ITEM_BYTES = 32_000_000

#: Stands between the texts of a batch: no letter, no blank, and unchanged by normalisation.
_BETWEEN = "\ufdd0"
#: Markup, entities and escapes, which are no words. A tag may have any length and line breaks if its
#: attributes have values; any other pointed brackets count as markup on one line.
_MARKUP = (
    r"</?[A-Za-z][\w:.-]*(?:[ \t\r\n]+[\w:.@-]+[ \t\r\n]*=[ \t\r\n]*(?:\"[^\"\ufdd0]*\"|'[^'\ufdd0]*'|[^\s\"'<>=\ufdd0]+))*[ \t\r\n]*/?>"
    r"|<!--(?:(?!-->)[^\ufdd0])*-->|<[^<>\n\ufdd0]{0,200}>|&[a-z]+;|&#x?[0-9a-fA-F]+;|\\[nrt\"]"
)
#: Marks inside a word (an apostrophe, a soft hyphen, an invisible joiner, emphasis), which don't part it.
_MARKS = "[\u00ad\u200b-\u200d\u2060\ufeff*_`~'\u2019]"


def _tokens(text: str) -> list[str]:
    import re
    import unicodedata

    text = re.sub(_MARKUP, " ", text)
    text = unicodedata.normalize("NFKC", text).casefold()
    return re.findall(r"\w+|\ufdd0", re.sub(_MARKS, "", text))


def words(text: str) -> list[str]:
    """The words of a text regardless of case, punctuation, spacing, line breaks and markup."""
    return _tokens(text.replace(_BETWEEN, " "))


#: Word hashes that a task remembers at most; texts repeat their words.
REMEMBERED = 200_000


class WordHashes(dict):
    """Hashes of words, computed when first asked for and forgotten all at once when there are too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def _running(hashes):
    """Running counts of each of the 64 bits over an array of uint64 hashes: row i counts the first i."""
    import numpy as np

    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros((len(hashes) + 1, BITS), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=counts[1:])
    return counts


def _prints(counts, starts, window: int):
    """SimHash of the windows at ``starts``: a bit is set where more of the window's words have it set than not."""
    import numpy as np

    votes = (counts[starts + window] - counts[starts]) * 2 > window
    return np.packbits(votes, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(hashes, window: int = WINDOW):
    """SimHash of every window of ``window`` word hashes (a uint64 array), as a uint64 array."""
    import numpy as np

    starts = np.arange(max(0, len(hashes) - window + 1))
    return _prints(_running(hashes), starts, window) if len(starts) else np.zeros(0, dtype=np.uint64)


def _within(bits: int, most: int):
    """All masks of ``bits`` bits with at most ``most`` of them set."""
    from itertools import combinations

    import numpy as np

    return np.array([sum(1 << b for b in some) for n in range(most + 1) for some in combinations(range(bits), n)], dtype=np.uint64)


def lengths(n: int) -> list[int]:
    """The lengths of item-sized windows up to ``n`` words, shortest first."""
    out = [SHORTEST]
    while (following := max(out[-1] + 1, round(out[-1] * STEP))) <= n:
        out.append(following)
    return out if n >= SHORTEST else []


class Blocks:
    """Fingerprints by Hamming block: those within ``radius`` bits of a given one are found without looking at all."""

    def __init__(self, prints, radius: int = RADIUS, blocks: int = BLOCKS) -> None:
        import numpy as np

        self.prints, self.radius = prints, radius
        reach = radius // blocks
        near = reach // 2  # so far the stored values are spread, and the rest of the reach those looked up
        self.tables = []
        for low, high in zip(range(0, BITS, BITS // blocks), range(BITS // blocks, BITS + 1, BITS // blocks)):
            own, asked = _within(high - low, near), _within(high - low, reach - near)
            mask = np.uint64((1 << (high - low)) - 1)
            values = (((prints >> np.uint64(low)) & mask)[:, None] ^ own).ravel().astype(np.int64)
            order = np.argsort(values, kind="stable")
            present = np.zeros(1 << (high - low), dtype=bool)
            present[values] = True
            self.tables.append((np.uint64(low), mask, asked, present, (order // len(own)).astype(np.int32), values[order]))

    def candidates(self, prints):
        """Pairs (place in ``prints``, place in the stored ones) whose fingerprints differ in at most ``radius`` bits."""
        import numpy as np

        found = []
        for low, mask, asked, present, order, values in self.tables:
            part = (((prints >> low) & mask)[:, None] ^ asked).astype(np.int64)
            at, way = np.nonzero(present[part])
            first, last = np.searchsorted(values, part[at, way], "left"), np.searchsorted(values, part[at, way], "right")
            count = last - first
            steps = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
            left, right = np.repeat(at, count), order[np.repeat(first, count) + steps]
            near = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
            found.append(left[near] * len(self.prints) + right[near])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


class Index:
    """The windows of a set of test items by fingerprint; small enough to be held by every task."""

    def __init__(
        self, items: list[tuple[object, str]], window: int = WINDOW, radius: int = RADIUS, least_similarity: float = LEAST_SIMILARITY
    ) -> None:
        import numpy as np

        self.window, self.least = window, least_similarity
        self.hashes = WordHashes()
        self.codes: dict[str, int] = {}  # words of the items, numbered from 1
        self.texts, self.ids = [], [i for i, _ in items]
        exact, sized = [], {}
        for k, (_, text) in enumerate(items):
            tokens = words(text)
            for token in tokens:
                self.codes.setdefault(token, len(self.codes) + 1)
            self.texts.append(np.array([self.codes[t] for t in tokens], dtype=np.int32))
            hashes = np.array([self.hashes[t] for t in tokens], dtype=np.uint64)
            exact += [(p, k, i) for i, p in enumerate(fingerprints(hashes, window))]
            counts, n = _running(hashes), len(tokens)
            for start, stop in {(0, n), (0, n // 2), (n - n // 2, n)}:
                for size in lengths(stop - start)[-1:]:
                    # Both ends of the stretch, so that all its words lie in one of the two.
                    for i in {start, stop - size}:
                        sized.setdefault(size, {})[(k, i)] = _prints(counts, np.array([i]), size)[0]
        exact.sort()
        self.exact = np.array([p for p, _, _ in exact], dtype=np.uint64)
        self.exact_at = [(k, i) for _, k, i in exact]
        self.codes[_BETWEEN] = -1
        self.sized = {}
        for size, found in sized.items():
            self.sized[size] = (list(found), Blocks(np.array(list(found.values()), dtype=np.uint64), radius))

    def _runs(self, codes, counts, offset, starts, texts, runs) -> None:
        """Equal windows, by text and item and the diagonal of places they lie on."""
        import numpy as np

        prints = _prints(counts, starts - offset, self.window)
        first, last = np.searchsorted(self.exact, prints, "left"), np.searchsorted(self.exact, prints, "right")
        hits = np.flatnonzero(last > first)
        for i, text, a, b in zip(starts[hits].tolist(), texts[hits].tolist(), first[hits].tolist(), last[hits].tolist()):
            for item, place in self.exact_at[a:b]:
                if (codes[i : i + self.window] == self.texts[item][place : place + self.window]).all():
                    runs.setdefault((text, item), {}).setdefault(i - place, []).append(i)

    def _near(self, codes, counts, offset, starts, texts, size, runs, best) -> None:
        """Item-sized windows within the radius, compared word pair by word pair; needless where a window is equal."""
        places, blocks = self.sized[size]
        at, found = blocks.candidates(_prints(counts, starts - offset, size))
        for i, text, j in zip(starts[at].tolist(), texts[at].tolist(), found.tolist()):
            item, place = places[j]
            if (text, item) not in runs:
                similarity = weighted_similarity(codes[i : i + size], self.texts[item][place : place + size])
                if similarity >= max(self.least, best.get((text, item), (0.0,))[0]):
                    best[text, item] = (similarity, 0, i)

    def search(self, texts: list[str]) -> list[tuple[int, int, float, int, int]]:
        """(text's number, item's number, best similarity, longest common run of words, its place) of each pair found.

        All texts are split at once. A window is looked up only if so many of its words are items' words that it can
        match: all for an equal one; for a similar one as many as it must have common pairs. Texts without such a
        window go no further.
        """
        import numpy as np

        tokens = _tokens(_BETWEEN.join(t.replace(_BETWEEN, " ") for t in texts))
        codes = np.fromiter(map(self.codes.get, tokens, repeat(0)), dtype=np.int32, count=len(tokens))
        known = np.concatenate([[0], np.cumsum(codes > 0)])
        breaks = np.concatenate([[0], np.cumsum(codes < 0)])
        begins = np.concatenate([[0], np.flatnonzero(codes < 0) + 1])

        def worth(size: int, least: float):
            n = len(codes) - size + 1
            if n <= 0:
                return np.zeros(0, dtype=np.int64)
            return np.flatnonzero((known[size:] - known[:n] >= least) & (breaks[size:] == breaks[:n]))

        share = 2 * self.least / (1 + self.least)
        sized = {size: worth(size, share * (size - 1)) for size in self.sized}
        equal = worth(self.window, self.window)
        kept = np.zeros(len(begins), dtype=bool)
        for starts in (equal, *sized.values()):
            kept[breaks[starts]] = True
        # The words of the texts that are left, end to end, and each window's place among them.
        inside = kept[breaks[:-1]] & (codes >= 0)
        to = np.cumsum(inside) - 1
        left = np.flatnonzero(inside)
        codes = codes[left]
        hashes = np.fromiter((self.hashes[tokens[i]] for i in left), dtype=np.uint64, count=len(left))
        runs: dict[tuple[int, int], dict[int, list[int]]] = {}
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        longest = max([self.window, *sized])
        for offset in range(0, len(codes), WORDS):
            counts = _running(hashes[offset : offset + WORDS + longest])
            for size, starts in [(0, equal), *sized.items()]:
                own = starts[slice(*np.searchsorted(to[starts], [offset, offset + WORDS]))]
                if not len(own):
                    continue
                if size:
                    self._near(codes, counts, offset, to[own], breaks[own], size, runs, best)
                elif len(self.exact):
                    self._runs(codes, counts, offset, to[own], breaks[own], runs)
        for key, diagonals in runs.items():
            best[key] = (1.0, *_longest(diagonals, self.window))
        return [(text, item, x, run, int(left[at] - begins[text])) for (text, item), (x, run, at) in best.items()]


#: Words whose bits are counted at once.
WORDS = 100_000


def _longest(diagonals: dict[int, list[int]], window: int) -> tuple[int, int]:
    """The longest run of common words, from the windows on each diagonal, and its first word's place."""
    longest, at = 0, 0
    for places in diagonals.values():
        run, start = 1, places[0]
        for a, b in zip(places, [*places[1:], None]):
            if b == a + 1:
                run += 1
                continue
            if run + window - 1 > longest:
                longest, at = run + window - 1, start
            run, start = 1, b
    return longest, at


def weighted_similarity(a, b, length: int = 2) -> float:
    """Weighted Jaccard similarity of the ``length``-word shingles of two windows of word numbers; a shingle weighs how often it occurs."""
    from collections import Counter

    def shingles(x):
        x = x.tolist()
        return Counter(zip(*[x[i:] for i in range(length)]))

    left, right = shingles(a), shingles(b)
    # A word that no item has is numbered 0 and equals nothing.
    common = sum(min(n, right[s]) for s, n in left.items() if s in right and all(w > 0 for w in s))
    total = sum(left.values()) + sum(right.values()) - common
    return common / total if total else 1.0


def _search(index) -> Callable[[Iterator], Iterator]:
    def run(batches):
        import pandas as pd

        own: Index = index.value
        for pdf in batches:
            texts, keys, first = pdf["text"].tolist(), pdf["doc_id"].tolist(), 0
            while first < len(texts):
                # So many texts at once that the words of all fit in memory, and always one.
                last, size = first + 1, len(texts[first])
                while last < len(texts) and size + len(texts[last]) <= TEXT_CHARS:
                    size, last = size + len(texts[last]), last + 1
                found = own.search(texts[first:last])
                if found:
                    rows = [(own.ids[item], keys[first + text], similarity, run, at) for text, item, similarity, run, at in found]
                    yield pd.DataFrame(rows, columns=["item_id", "doc_id", "similarity", "shared_words", "at_word"])
                first = last

    return run


#: Characters of text that a task splits into words at once; a longer text goes alone.
TEXT_CHARS = 4_000_000


def leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    window: int = WINDOW, radius: int = RADIUS, least_similarity: float = LEAST_SIMILARITY, item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The documents that hold passages of test items: item_id, doc_id, similarity, shared_words, at_word.

    Windows of documents and items have SimHashes. Two kinds of them lead to a pair:

    - equal windows of ``window`` words, which have equal fingerprints, so that every common run of so many words is
      found; ``shared_words`` is the longest one, ``similarity`` 1;
    - item-sized windows (of the length of the item or of one of its halves, rounded down to a step of ``STEP``) whose
      fingerprints differ in at most ``radius`` bits. Those are found through Hamming blocks, none missed; then the
      windows themselves are compared by the weighted Jaccard similarity of their word pairs, which must be
      ``least_similarity`` or more. ``shared_words`` is 0 if no run of ``window`` words is common.

    ``at_word`` is the place of the run or window in the document. Texts count regardless of case, punctuation, spacing,
    line breaks and markup, and are read whole. NULL or short texts match nothing; repeated rows give one pair. The
    items are held by every task, in passes of at most ``item_bytes`` of text, so their size is bounded whatever their
    number; documents stay where they are read.
    """
    spark = docs.sparkSession
    held = items.select(F.col(f"`{item_key}`").alias("i"), F.col(f"`{item_text}`").alias("t")).dropna()
    size = int(held.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0])
    passes = max(1, -(-size // item_bytes))
    kinds, item_kinds = dict(docs.dtypes), dict(items.dtypes)
    schema = f"item_id {item_kinds[item_key]}, doc_id {kinds[key]}, similarity double, shared_words long, at_word long"
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).dropna()
    found = None
    for part in range(passes):
        own = held.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == part)
        index = spark.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in own.collect()], window, radius, least_similarity))
        pairs = source.mapInPandas(_search(index), schema)
        found = pairs if found is None else found.unionByName(pairs)
    assert found is not None
    best = F.max_by(F.struct("similarity", "shared_words", "at_word"), F.struct("shared_words", "similarity"))
    return found.groupBy("item_id", "doc_id").agg(best.alias("b")).select("item_id", "doc_id", "b.*")


def full_matches(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, doc_id of the pairs that share ``window`` or more consecutive words."""
    return found.where(F.col("shared_words") >= window).select("item_id", "doc_id")


def words_column(text: Column) -> Column:
    """:func:`words` for a column, for checks against brute force on small tables."""

    @F.pandas_udf("array<string>")
    def split(texts):
        return texts.map(lambda t: words(t) if t is not None else None)

    return split(text)
