"""N-gram Jaccard join by rare shared features, and by PartEnum signatures where those are frequent.

Documents are sets of distinct word shingles; two link when their Jaccard similarity reaches the threshold, so a set that
links shares at least that part of its features with one other. A first look takes features from a fixed share of the hashed
domain, twice what a link may lack: texts of which too many there are theirs alone can link with nothing and take no
further part, for most texts at less than half the cost of all features.

Of the other texts, features are counted, and each set's are put in order, those of the fewest sets first. Linked sets
share one among the first (those a link may lack and one more), so these are signatures, apart by bands of sizes. Unrelated
texts, however long and however many lines they share, meet only by rare features.

Where a set's first features include one of more than SMALL sets, PartEnum takes the place of these. Sets are
grouped into bands of about equal size. For a pair whose smaller set lies in a band, similarity bounds the Hamming
distance by some k. PartEnum divides the feature domain by hash into first-level partitions, enough that at least two
of them hold at most one difference each, and each into three second-level parts; a signature is the content of two of
the three. Linked sets therefore share a signature (for k of 3 or less one first-level partition with k + 2 parts does).
Signatures without features say nothing: two first-level partitions must both be empty there, and these pairs of empty
parts are signatures as well, so that no link is lost. Features of one set alone are left out, which adds no difference.

Signatures are sorted; groups of one vanish, and small groups (up to SMALL sets) of the same members are one. Their members
are joined with their sizes and 512-bit parity sketches, which differ in no more bits than the sets do in features; a member
goes out with the least one of its group that these let it link with, and longer sketches of large sets are compared before
texts are. Larger groups propose each member with the group's least one. After the links found so far are contracted to
components, small groups propose the pairs that lie in different ones and may link. Of large groups only
members that lie in different components remain, and of these only pairs whose distances to the group's
least member differ by no more than a link can (Jaccard distance is a metric) and whose sketches are alike. All
proposals that remain are verified exactly.

Equal texts share a 64-bit key and are one class throughout. Defined cases: null and empty texts and texts without words
have n_shingles 0 and link with nothing; null ids keep their row, with component_id null unless linked to ids; repeated
rows are equal texts; an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, hot_keys, mix, salted_join, signed, word_shingles

WIDTH = 4
NUM, DEN = 85, 100  # similarity threshold
SMALL = 256
_RATIO = 1.4
_LIMIT = 1 << 40
_SEEN = 200_000


@functools.lru_cache
def _bands(num: int, den: int) -> tuple[list[int], list[int], list[int]]:
    """First and last sizes of bands, and the Hamming distances that links with the smaller set there can have."""
    low, high, most = [], [], []
    at = 1
    while at < _LIMIT:
        end = max(at, math.ceil(at * _RATIO) - 1)
        low.append(at)
        high.append(end)
        most.append((den - num) * (end + end * den // num) // (den + num))
        at = end + 1
    return low, high, most


def _jobs(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, distance) of the bands under which a set of this size has signatures: its own, and the lower one that its
    links may lie in."""
    low, high, most = _bands(num, den)
    own = bisect.bisect_right(low, size) - 1
    bands = [own] if own == 0 or size > high[own - 1] * den // num else [own, own - 1]
    return [(k, most[k]) for k in bands]


def _plan(k: int) -> tuple[int, int]:
    """(first-level partitions, second-level parts)"""
    return (1, k + 2) if k <= 3 else (k // 2 + 2, 3)


def signatures(features: np.ndarray, num: int = NUM, den: int = DEN, size: int | None = None) -> np.ndarray:
    """Distinct signatures of a set of feature hashes. Features that no other set has may be left out; size counts them."""
    out = []
    whole = np.uint64(len(features) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for band, k in _jobs(size or len(features), num, den):
        salt = np.uint64((band + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)
        if k == 0:
            out.append(mix(np.array([np.bitwise_xor.reduce(mix(features)) ^ whole ^ salt])))
            continue
        n1, n2 = _plan(k)
        cells = n1 * n2
        cell = ((features >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
        # A cell's content: the sum of its features' mixed hashes; which features lie in a cell is fixed by band and hash.
        content = np.zeros(cells, np.uint64)
        np.add.at(content, cell, mix(features ^ salt))
        filled = np.bincount(cell, minlength=cells)
        content, filled = content.reshape(n1, n2), filled.reshape(n1, n2)
        empty = []
        for number, (i, j) in enumerate(itertools.combinations(range(n2), 2)):
            place = np.arange(n1, dtype=np.uint64) * np.uint64(64) + np.uint64(number)
            sig = mix(mix(content[:, i] ^ salt) * np.uint64(3) + content[:, j] + mix(place + salt))
            if k <= 3:
                out.append(sig)
            else:
                has = (filled[:, i] + filled[:, j]) > 0
                out.append(sig[has])
                empty += [(p, int(place[p])) for p in np.flatnonzero(~has)]
        pairs = [(a[1], b[1]) for a, b in itertools.combinations(sorted(empty), 2) if a[0] != b[0]]
        if pairs:
            both = np.array(pairs, np.uint64)
            out.append(mix(mix(both[:, 0] + salt) * np.uint64(5) + both[:, 1]))
    return np.unique(np.concatenate(out))


SKETCH = 8  # 64-bit words


def sketch(features: np.ndarray) -> np.ndarray:
    """Parities of the features' counts in 512 hashed cells. Each feature that only one of two sets has turns one bit,
    so their sketches differ in no more bits than the sets do in features."""
    cell = (mix(features) >> np.uint64(55)).astype(np.int64)
    odd = np.bincount(cell, minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_Q = [f"q{k}" for k in range(SKETCH)]
_LONG = 500


def long_sketch(features: np.ndarray) -> np.ndarray | None:
    """The parities of a large set, for which 512 cells say little, in at least four times as many cells as features."""
    if len(features) <= _LONG:
        return None
    cells = 4 << (len(features) - 1).bit_length()
    odd = np.bincount((mix(features) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_counts(docs: DataFrame, width: int) -> DataFrame:
    """(id, key, n_shingles, sketch columns) of every document; docs: id, key, data."""

    def count(batches):
        for batch in batches:
            sets = (word_shingles(d.as_py(), width) if d.is_valid else None for d in batch.column("data"))
            out = [(0 if x is None else len(x), sketch(x) if x is not None and len(x) else np.zeros(SKETCH, np.int64), None if x is None else long_sketch(x)) for x in sets]
            n, own = [x[0] for x in out], np.array([x[1] for x in out], np.int64).reshape(-1, SKETCH)
            more = pa.array([x[2] for x in out], pa.list_(pa.int64()))
            columns = [batch.column("id"), batch.column("key"), pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(own[:, k])) for k in range(SKETCH)), more]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n_shingles", *_Q, "long"])

    return docs.mapInArrow(count, f"id {dict(docs.dtypes)['id']}, key bigint, n_shingles bigint, " + ", ".join(f"{q} bigint" for q in _Q) + ", long array<bigint>")


def long_alike(x: str, y: str, num: int, den: int) -> Column:
    """As alike, by long sketches where both sets have one; the longer is folded to the shorter's length, for sizes
    that can link are at most one doubling apart."""
    a, b = F.col(f"{x}long"), F.col(f"{y}long")
    n = F.least(F.size(a), F.size(b))
    xor = lambda p, q: F.zip_with(p, q, lambda i, j: i.bitwiseXOR(j))
    fold = lambda c: F.when(F.size(c) > n, xor(F.slice(c, 1, n), F.slice(c, n + 1, n))).otherwise(c)
    bits = F.aggregate(xor(fold(a), fold(b)), F.lit(0), lambda t, v: t + F.bit_count(v))
    return F.coalesce(bits * (den + num) <= (F.col(f"{x}size") + F.col(f"{y}size")) * (den - num), F.lit(True))


def alike(x: str, y: str, num: int, den: int) -> Column:
    """Whether sizes and sketches let two sets link; columns are named by these prefixes."""
    bits = [F.bit_count(F.col(f"{x}{q}").bitwiseXOR(F.col(f"{y}{q}"))) for q in _Q]
    a, b = F.col(f"{x}size"), F.col(f"{y}size")
    return (F.least(a, b) * den >= F.greatest(a, b) * num) & (sum(bits[1:], bits[0]) * (den + num) <= (a + b) * (den - num))


def _needed(size, num: int, den: int):
    """Features that a set of this size shares at least with one it links with."""
    return (size * num + den - 1) // den


def _looked_at(features: np.ndarray, num: int, den: int) -> np.ndarray:
    """The features of a fixed share of the domain, twice what a link may lack."""
    return features[mix(features ^ np.uint64(0x5851F42D4C957F2D)) < np.uint64(min((1 << 64) - 1, (2 * (den - num) << 64) // den))]


def _first_look(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Rows (sig, key, need) of the features looked at. A feature that one text of a batch holds brings its key. One that several
    hold is known to be shared and goes out once, without a key, so that a frequent one is a row a batch. Each text has a row with
    the shared features that it still needs, and no feature's. A task skips texts it has lately met."""

    def look(batches):
        seen: OrderedDict = OrderedDict()
        for batch in batches:
            sigs, keys, sizes = [], [], []
            for key, data in zip(batch.column("key").to_pylist(), batch.column("data"), strict=True):
                if key in seen:
                    continue
                seen[key] = None
                if len(seen) > _SEEN:
                    seen.popitem(last=False)
                features = word_shingles(data.as_py() or b"", width)
                if len(features):
                    sigs.append(_looked_at(features, num, den))
                    keys.append(key)
                    sizes.append(len(features))
            if not keys:
                continue
            own, size, length = np.array(keys, np.int64), np.array(sizes), np.array([len(x) for x in sigs])
            sig, at, count = np.unique(np.concatenate(sigs), return_index=True, return_counts=True)
            text = np.repeat(np.arange(len(own)), length)[at]
            lone = count == 1
            alone = np.bincount(text[lone], minlength=len(own))
            # What is shared in the batch counts at once; what is left to find are features that are alone in it.
            need = alone - (size - _needed(size, num, den))
            holder = pa.array(own[text], mask=~lone)
            yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), holder, pa.nulls(len(sig), pa.int64())], ["sig", "key", "need"])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own), pa.array(need)], ["sig", "key", "need"])

    return docs.mapInArrow(look, "sig bigint, key bigint, need bigint")


def _shared_counts(batches):
    """From rows of the first look, sorted by (sig, key), rows (key, need, shared): of texts what they need, and how many of
    their features other texts hold as well."""

    def counts(sig, key, known):
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        new = known & np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]) | ~known[:-1]))
        length = np.diff(np.concatenate((start, [len(sig)])))
        several = (np.add.reduceat(new.astype(np.int64), start) > 1) | (np.add.reduceat((~known).astype(np.int64), start) > 0)
        found, n = np.unique(key[new & np.repeat(several, length)], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.nulls(len(found), pa.int64()), pa.array(n)], ["key", "need", "shared"])

    rest = None  # the last feature, with a row for each batch of texts at most
    for batch in batches:
        lists = batch.column("need").is_valid()
        texts, batch = batch.filter(lists), batch.filter(pc.invert(lists))
        if len(texts):
            yield pa.RecordBatch.from_arrays([texts.column("key"), texts.column("need"), pa.array(np.zeros(len(texts), np.int64))], ["key", "need", "shared"])
        if not len(batch):
            continue
        own = [batch.column("sig").to_numpy(), batch.column("key").fill_null(0).to_numpy(), batch.column("key").is_valid().to_numpy(zero_copy_only=False)]
        if rest is not None:
            own = [np.concatenate(x) for x in zip(rest, own, strict=True)]
        last = int(np.searchsorted(own[0], own[0][-1], "left"))
        rest = [x[last:] for x in own]
        if last:
            yield counts(*[x[:last] for x in own])
    if rest is not None:
        yield counts(*rest)


def _features(texts: DataFrame, width: int) -> DataFrame:
    """(sig, key, size) of every feature; texts: key, data, one row a key."""

    def rows(batches):
        for batch in batches:
            sigs, keys, count = [], [], 0

            def out(sigs, keys):
                n = np.array([len(x) for x in sigs])
                columns = [signed(np.concatenate(sigs)), np.repeat(np.array(keys, np.int64), n), np.repeat(n, n)]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["sig", "key", "size"])

            for key, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if len(features := word_shingles(data, width)):
                    sigs.append(features)
                    keys.append(key)
                    count += len(features)
                if count > 100_000:  # what a task holds does not grow with the batch
                    yield out(sigs, keys)
                    sigs, keys, count = [], [], 0
            if sigs:
                yield out(sigs, keys)

    return texts.mapInArrow(rows, "sig bigint, key bigint, size bigint")


_OFTEN = 1_000_000


def _frequencies(batches):
    """From features sorted by sig, those of two sets or more with their number of sets, at most _OFTEN."""

    def emit(sig, key, size, df):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, size, df, sig)], ["key", "size", "df", "sig"])

    rest, often = None, None  # the last feature; one of over _OFTEN sets, of which the first have gone out
    for batch in batches:
        own = [batch.column(c).to_numpy() for c in ("sig", "key", "size")]
        if not len(own[0]):
            continue
        if often is not None:
            n = int(np.searchsorted(own[0], often, "right"))
            if n:
                yield emit(*[x[:n] for x in own], np.full(n, _OFTEN))
            if n == len(own[0]):
                continue
            own, often = [x[n:] for x in own], None
        if rest is not None:
            own, rest = [np.concatenate(x) for x in zip(rest, own, strict=True)], None
        sig = own[0]
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        length = np.diff(np.concatenate((start, [len(sig)])))
        df, last = np.repeat(np.minimum(length, _OFTEN), length), int(start[-1])
        if length[-1] >= _OFTEN:
            often, last = sig[-1], len(sig)
        else:
            rest = [x[last:] for x in own]
        at = np.flatnonzero(df[:last] > 1)
        if len(at):
            yield emit(*[x[at] for x in own], df[at])
    if rest is not None and len(rest[0]) > 1:
        yield emit(*rest, np.full(len(rest[0]), len(rest[0])))


def _prefixes(batches, num: int = NUM, den: int = DEN, small: int = SMALL):
    """Signatures (sig, key) of sets, from their shared features sorted by (key, df, sig): the features of up to ``small`` sets that
    the prefix holds, and if it holds others as well, those of PartEnum."""
    low, high, _ = (np.array(x) for x in _bands(num, den))

    def signed_off(key, size, df, sig):
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.concatenate((start, [len(key)])))
        sig = sig.view(np.uint64)
        # The features of no other set come first.
        take = size[start] - _needed(size[start], num, den) + 1 - (size[start] - length)
        inside = np.arange(len(key)) - np.repeat(start, length) < np.repeat(take, length)
        at = np.flatnonzero(inside & (df <= small))
        own = np.searchsorted(low, size[at], "right") - 1
        below = np.flatnonzero((own > 0) & (size[at] <= high[own - 1] * den // num))
        band = np.concatenate((own, own[below] - 1)).astype(np.uint64)
        at = np.concatenate((at, at[below]))
        sigs, keys = [mix(sig[at] ^ ((band + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)))], [key[at]]
        for k in np.flatnonzero(np.add.reduceat((inside & (df > small)).astype(np.int64), start)):
            sigs.append(signatures(sig[start[k] : start[k] + length[k]], num, den, int(size[start[k]])))
            keys.append(np.full(len(sigs[-1]), key[start[k]]))
        return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(sigs))), pa.array(np.concatenate(keys))], ["sig", "key"])

    rest = None
    for batch in batches:
        own = [batch.column(c).to_numpy() for c in ("key", "size", "df", "sig")]
        if not len(own[0]):
            continue
        if rest is not None:
            own = [np.concatenate(x) for x in zip(rest, own, strict=True)]
        last = int(np.searchsorted(own[0], own[0][-1], "left"))
        rest = [x[last:] for x in own]
        if last:
            yield signed_off(*[x[:last] for x in own])
    if rest is not None:
        yield signed_off(*rest)


def survivors(docs: DataFrame, width: int, num: int = NUM, den: int = DEN) -> DataFrame:
    """Keys of the texts that may link: not so many of the features looked at are theirs alone that too few are left."""
    rows = _first_look(docs, width, num, den).repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(_shared_counts, "key bigint, need bigint, shared bigint")
    return rows.groupBy("key").agg(F.max("need").alias("need"), F.sum("shared").alias("shared")).filter("shared >= need").select("key")


def signature_rows(texts: DataFrame, width: int, num: int = NUM, den: int = DEN) -> DataFrame:
    """(sig, key); texts: key, data, one row a key."""
    features = _features(texts, width).repartition("sig").sortWithinPartitions("sig").mapInArrow(_frequencies, "key bigint, size bigint, df bigint, sig bigint")
    small = SMALL  # one value for all workers
    return features.repartition("key").sortWithinPartitions("key", "df", "sig").mapInArrow(lambda batches: _prefixes(batches, num, den, small), "sig bigint, key bigint")


def _fits(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes can link."""
    return np.minimum(a, b).astype(np.int64) * den >= np.maximum(a, b).astype(np.int64) * num


def _shared(batches):
    """From rows sorted by (sig, key), those of groups of two or more: members of small groups (kind 0, b null) and
    (member, least member) of large ones (kind 1)."""

    def emit(kind, sig, a, b=None):
        other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(sig), pa.array(a), other], ["kind", "sig", "a", "b"])

    def groups(sig, key):
        """Whole groups, without a loop over them."""
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        length = np.diff(np.concatenate((start, [len(sig)])))
        own, first = np.repeat(length, length), np.repeat(key[start], length)
        at = np.flatnonzero((own > 1) & (own <= SMALL))
        if len(at):
            # Named by its members: the many groups that the same sets share become one.
            name = signed(mix(np.add.reduceat(mix(key.view(np.uint64)), start)))
            yield emit(0, np.repeat(name, length)[at], key[at])
        at = np.flatnonzero((own > SMALL) & (first != key))
        if len(at):
            yield emit(1, sig[at], key[at], first[at])

    rest = None  # the last group, which the next batch may continue
    hub = None  # (sig, least key, last key) of a large group whose begin has gone out
    for batch in batches:
        sig, key = (batch.column(c).to_numpy() for c in ("sig", "key"))
        if not len(sig):
            continue
        if rest is not None:
            sig, key = (np.concatenate(x) for x in zip(rest, (sig, key), strict=True))
            rest = None
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])))
        if hub is not None:
            own = int(np.searchsorted(sig, hub[0], "right"))
            at = np.flatnonzero(new[:own] & (key[:own] != hub[2]))
            if len(at):
                yield emit(1, sig[at], key[at], np.full(len(at), hub[1]))
            if own == len(sig):
                hub = (hub[0], hub[1], key[-1])
                continue
            sig, key, new, hub = sig[own:], key[own:], new[own:], None
        sig, key = sig[new], key[new]
        last = int(np.searchsorted(sig, sig[-1], "left"))
        if len(sig) - last > SMALL:
            hub = (sig[-1], key[last], key[-1])
            yield from groups(sig, key)
        else:
            rest = (sig[last:], key[last:])
            yield from groups(sig[:last], key[:last])
    if rest is not None:
        yield from groups(*rest)


def _whole_groups(batches, columns):
    """Arrays of these columns and of the sketches, from rows sorted by (sig, key); no group is in two of them."""
    rest = None
    for batch in batches:
        own = [batch.column(c).to_numpy() for c in columns]
        if not len(own[0]):
            continue
        own.append(np.stack([batch.column(q).to_numpy() for q in _Q], axis=1).view(np.uint64))
        if rest is not None:
            own = [np.concatenate(x) for x in zip(rest, own, strict=True)]
        last = int(np.searchsorted(own[0], own[0][-1], "left"))
        rest = [x[last:] for x in own]
        if last:
            yield [x[:last] for x in own]
    if rest is not None:
        yield rest


def _alike_at(sig: np.ndarray, size: np.ndarray, own: np.ndarray, num: int, den: int):
    """(step, places): of rows whose group holds another ``step`` places on, those that sizes and sketches let link with it.
    By offset within the group: no loop over groups."""
    for step in itertools.count(1):
        at = np.flatnonzero(sig[:-step] == sig[step:]) if len(sig) > step else []
        if not len(at):
            return
        at = at[_fits(size[at], size[at + step], num, den)]
        for part in np.array_split(at, len(at) // 50_000 + 1):
            bits = np.bitwise_count(own[part] ^ own[part + step]).sum(axis=1, dtype=np.int64)
            part = part[bits * (den + num) <= (size[part] + size[part + step]) * (den - num)]
            if len(part):
                yield step, part


def _once(found):
    """Batches of (a, b), rows that come again soon left out."""
    held, count = [], 0

    def out():
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from pa.table({"a": a, "b": b}).group_by(["a", "b"]).aggregate([]).combine_chunks().to_batches()

    for pair in found:
        held.append(pair)
        count += len(pair[0])
        if count > 200_000:
            yield from out()
            held, count = [], 0
    if held:
        yield from out()


def _firsts(batches, num: int = NUM, den: int = DEN):
    """Of small groups, sorted by (sig, key), each member that may link with another: with the least that it may link with,
    or with itself if that is greater. A row a member, not a pair."""

    def found():
        for sig, key, size, own in _whole_groups(batches, ("sig", "key", "size")):
            least = np.full(len(sig), -1)
            for step, at in _alike_at(sig, size, own, num, den):
                lone = at[least[at] < 0]
                least[lone] = lone
                least[at + step] = at  # greater steps come later and reach lesser keys
            at = np.flatnonzero(least >= 0)
            if len(at):
                yield key[at], key[least[at]]

    yield from _once(found())


def _proposals(batches, num: int = NUM, den: int = DEN):
    """Of small groups, sorted by (sig, key), the pairs that may link and lie in different components, the greater key first."""

    def found():
        for sig, key, size, part, own in _whole_groups(batches, ("sig", "key", "size", "part")):
            for step, at in _alike_at(sig, size, own, num, den):
                at = at[part[at] != part[at + step]]
                if len(at):
                    yield key[at + step], key[at]

    yield from _once(found())


def verify(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, shared, size_a, size_b) of key pairs; texts: key, data, one row a key."""
    t = lambda c: texts.select(F.col("key").alias(c), F.col("data").alias(f"data_{c}"))
    rows = pairs.select("a", "b").join(t("a"), "a").join(t("b"), "b")

    def compare(batches):
        held: OrderedDict = OrderedDict()

        def features(key, data):
            if key not in held:
                held[key] = word_shingles(data, width)
                if len(held) > 512:
                    held.popitem(last=False)
            return held[key]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out = []
            for x, y, dx, dy in zip(a, b, batch.column("data_a").to_pylist(), batch.column("data_b").to_pylist(), strict=True):
                p, q = features(x, dx), features(y, dy)
                out.append((len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)))
            columns = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(np.ascontiguousarray(columns[:, k])) for k in range(3))], ["a", "b", "shared", "size_a", "size_b"])

    return rows.mapInArrow(compare, "a bigint, b bigint, shared bigint, size_a bigint, size_b bigint")


def classes(documents: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_shingles, component) of every document; component is a text key, null where there are no words.
    Documents link at a similarity of num / den or more."""
    linked = f"shared * {den} >= (size_a + size_b - shared) * {num}"
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs = documents.select(F.col(id_col).alias("id"), text.alias("data")).withColumn("key", F.xxhash64("data"))
    counted = cut(shingle_counts(docs, width), "counted")
    keys = counted.groupBy("key").agg(F.min("id").alias("carrier"), F.min("n_shingles").alias("size"), *[F.min(q).alias(q) for q in _Q], F.first("long").alias("long"))
    side = lambda c: keys.filter("long is not null").select(F.col("key").alias(c), F.col("size").alias(f"{c}_size"), F.col("long").alias(f"{c}_long"))

    # The texts that take part, one a key, carried by its least id: ids spread evenly where keys may not.
    live = cut(survivors(docs, width, num, den), "live")
    wanted = live.join(keys.select("key", "carrier"), "key").select(F.col("key").alias("w_key"), "carrier")
    texts = docs.join(wanted, F.col("id").eqNullSafe(F.col("carrier")) & (F.col("key") == F.col("w_key"))).select("key", "data").dropDuplicates(["key"])
    texts = cut(texts, "texts")
    found = cut(signature_rows(texts, width, num, den).repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(_shared, "kind byte, sig bigint, a bigint, b bigint"), "shared")

    # Members of small groups pass sketches where they meet, before they or texts move, and go out with one other, not in
    # pairs. Pairs of large groups are kept: their distances serve the last step.
    stars = found.filter("kind = 1").select("a", "b").distinct()
    groups = cut(found.filter("kind = 0").select("sig", F.col("a").alias("key")).distinct(), "groups")
    met = lambda rows, step: rows.join(keys.select("key", "size", *_Q), "key").repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(lambda batches: step(batches, num, den), "a bigint, b bigint").distinct()
    longer = lambda pairs: pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(long_alike("a_", "b_", num, den)).select("a", "b")
    firsts = cut(met(groups, _firsts), "firsts")

    # First each text with the least it is proposed with, then only what those links leave apart.
    first = longer(firsts.filter("a <> b")).groupBy("a").agg(F.min("b").alias("b")).union(stars).distinct()
    checked = cut(verify(first, texts, width), "checked")
    links = checked.filter(linked).select("a", "b")
    part = components(links)

    tagged = groups.join(part.select(F.col("id").alias("key"), "component"), "key", "left").select("sig", "key", F.coalesce("component", "key").alias("part"))
    tagged = cut(tagged, "tagged")
    apart = tagged.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("sig")
    left = longer(met(tagged.join(apart, "sig"), _proposals)).join(checked.select("a", "b"), ["a", "b"], "left_anti")
    links = cut(links.union(verify(left, texts, width).filter(linked).select("a", "b")), "links")
    part = components(links)

    rest = cut(large_groups(found, checked, keys, part, num, den), "rest")
    if not rest.isEmpty():
        links = links.union(verify(rest, texts, width).filter(linked).select("a", "b"))
        part = components(links)

    # Components of texts become components of documents.
    hot = hot_keys(counted.groupBy("key").agg(F.count("*").alias("n")), ["key"])
    small = part.select(F.col("id").alias("key"), "component")
    rows = salted_join(counted.select("id", "key", "n_shingles"), small, ["key"], hot, ["id"], "left")
    return cut(rows.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "key"))), "classes")


def join(documents: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id); documents link at a similarity of num / den or more."""
    rows = classes(documents, width, num, den, id_col, text_col)
    groups = cut(rows.filter("component is not null").groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "components")
    lowest = groups.filter("n > 1").drop("n")
    out = salted_join(rows, lowest, ["component"], hot_keys(groups, ["component"]), ["id"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def keep_one(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, as they are, without those that a kept one stands for: of each group of linked documents the row with
    the least id stays, rows without an id last, of several the one with the least text key, of equal rows one.

    Defined cases: texts without words are linked with nothing and all stay; rows that share an id or have none are told
    apart by their texts; an empty table stays empty; other columns, whatever their names, play no part.
    """
    rows = classes(documents, width, num, den, id_col, text_col).filter("component is not null")
    own = rows.groupBy("component", "id", "key").agg(F.count("*").alias("n"))
    least = own.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "n")).alias("x"))
    kept = least.select(F.col("x.id").alias("kept_id"), F.col("x.key").alias("kept_key"), F.col("x.n").alias("n"))
    # The row itself travels as one column, so that no name can clash.
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(text).alias("own_key"))
    silent = packed.filter(~F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("row")
    found = packed.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_key") == F.col("kept_key")))
    once = found.filter("n = 1").select("row")
    # Equal rows are rare: only they need to meet.
    again = found.filter("n > 1").groupBy("own_id", "own_key").agg(F.first("row").alias("row")).select("row")
    return silent.union(once).union(again).select("row.*")


def large_groups(found: DataFrame, checked: DataFrame, keys: DataFrame, part: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Pairs that large groups still leave open: in different components, distances to the group's least member alike."""
    d = checked.select("a", "b", (F.lit(1.0) - F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("d"))
    rows = found.filter("kind = 1").select("sig", "a", "b").join(d, ["a", "b"])
    rows = rows.join(part.select(F.col("id").alias("a"), "component"), "a", "left").select("sig", F.col("a").alias("key"), "d", F.coalesce("component", "a").alias("part"))
    rows = cut(rows, "members")
    open_ = rows.groupBy("sig").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("sig")
    rows = cut(rows.join(open_, "sig"), "open")
    # Every pair goes out once, from the least of the groups that it shares.
    own = rows.groupBy("key").agg(F.collect_set("sig").alias("sigs")).join(keys.select("key", "size", *_Q), "key")
    rows = rows.join(own, "key")
    reach = 1 - num / den
    step = reach * 1.0000001
    cell = F.floor(F.col("d") / step)
    named = lambda c: [F.col(n).alias(f"{c}_{n}") for n in ("key", "d", "part", "sigs", "size", *_Q)]
    # Members linked to the least one are all in one component: at least one of an open pair is not linked to it.
    far = rows.filter(F.col("d") > reach).select(F.col("sig").alias("x_sig"), *named("x"), F.explode(F.array(*[cell + k for k in (-1, 0, 1)])).alias("x_cell"))
    near = rows.select(F.col("sig").alias("y_sig"), *named("y"), cell.alias("y_cell"))
    same = (F.col("x_sig") == F.col("y_sig")) & (F.col("x_cell") == F.col("y_cell")) & (F.col("x_part") != F.col("y_part"))
    once = ((F.col("y_d") <= reach) | (F.col("x_key") > F.col("y_key"))) & (F.array_min(F.array_intersect("x_sigs", "y_sigs")) == F.col("x_sig"))
    open_pairs = far.join(near, same & (F.abs(F.col("x_d") - F.col("y_d")) <= step) & alike("x_", "y_", num, den) & once)
    return open_pairs.select(F.greatest("x_key", "y_key").alias("a"), F.least("x_key", "y_key").alias("b")).distinct()
