"""Sampled SentencePiece segmentations without replacement, and decoding (operator 9).

A text's segmentations are the paths of its piece lattice; a path's log probability is the sum
of its pieces' log probabilities, times ``alpha``, less the lattice's log total. Gumbel top-k:
give every path the sum of its log probability and Gumbel noise; the k largest are a sample
without replacement. The paths are too many to list, so they are searched best first (A*): a set
of paths with a common prefix has a perturbed maximum whose distribution is known from the
backward sums of the lattice, and the set with the largest maximum is opened next. Opening the
root follows the winning piece at each node and leaves, per node, the set of the losing ones with
a maximum drawn below the winner's; the k-1 sets with the largest maxima are kept, since no other
can be opened. Each set opened so gives one more path.

Words are units that no piece crosses, so the lattice of a text is a chain of unit lattices. Each
worker keeps unit lattices in one bounded table, and rolls the units of many texts on together
with NumPy. Random numbers are hashes of (row key, sample, unit, step): results do not depend on
batches, partitions or retries.

A piece's log probability follows Zipf's law on its merge rank: -log(rank + 2), normalised by the
lattice. Characters without a piece become their bytes' pieces.
"""

from __future__ import annotations

import gc
import math
import re
from collections import defaultdict
from itertools import count, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import sliced, worker_state

SPACE = "▁"
ARCS_KEPT = 400_000      # arcs in a worker's lattice table before it starts anew: most units are rare, so little is made twice
UNITS_TOGETHER = 20_000  # units of several texts rolled on together
ROWS_TOGETHER = 512      # rows of an Arrow batch turned into Python texts at once
_NEVER = -math.inf
_STEP = 0xE7037ED1A0B428DB  # between the counters of a unit's steps


class Vocabulary:
    """Pieces of a SentencePiece model (given as the model file's bytes)."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.vocab_size()
        self.pieces, self.byte_ids, self.bytes_of = {}, {}, []
        for i in range(n):
            piece = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                rank = min(-self.sp.get_score(i), n)
                self.pieces[piece] = (i, -math.log(rank + 2.0))
                self.bytes_of.append(piece.encode())
        import numpy as np

        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.bytes_len = np.array(list(map(len, self.bytes_of)), dtype=np.int64)
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        self.rare = -math.log(n + 2.0)
        self.longest = max(map(len, self.pieces), default=1)
        # Units: no piece holds a blank after another character, or a newline.
        inner = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        line = not any("\n" in p for p in self.pieces if len(p) > 1)
        self.units = re.compile(r"(?s).+" if inner else
                                (rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if line else rf"{SPACE}*[^{SPACE}]+|{SPACE}+"))
        self.words = line and not inner

    def cut(self, text: str):
        """The units of a normalised text, in order."""
        if len(text) > 1 << 20:
            return (m.group() for m in self.units.finditer(text))
        if self.words and "\0" not in text and SPACE * 2 not in text:  # the same units, cut faster
            return filter(None, text.replace("\n", "\0\n\0").replace(SPACE, "\0" + SPACE).split("\0"))
        return self.units.findall(text)

    def normalise(self, text: str) -> str:
        return self.sp.normalize(text)

    def decode(self, ids) -> str:
        """The text of a sequence of ids: bytes put together, blanks restored, the blank that
        normalising put in front taken off."""
        return next(self.decode_all(ids, [0, len(ids)]))

    def decode_all(self, ids, bounds):
        """The texts of the stretches of ``ids`` between neighbouring ``bounds``."""
        import numpy as np

        ids = np.asarray(ids, dtype=np.int64)
        size = self.bytes_len[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.flat[np.repeat(self.bytes_at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cuts = ends[np.asarray(bounds)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            text = data[a:b].decode("utf-8", "replace").replace(SPACE, " ")
            yield text[1:] if text.startswith(" ") else text


class Lattices:
    """Unit lattices in flat arrays. A row is a unit's rest from some character on, and units
    with the same ending share its rows. A row's arcs stand together, longer pieces first;
    ``upto`` is the running probability within the row.

    A unit is only numbered when met; the rows and arcs of all new units come together. A rest is
    its first character and the row of the rest after it, so rests are found or made from the
    units' ends on, one length after the other (``link`` has the known pairs, sorted), and their
    arcs by a walk through a byte trie of the pieces."""

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        import numpy as np

        self.v, self.alpha = vocabulary, alpha
        steps: list[dict] = [{}, {}]  # state 0: no piece goes on so; state 1: nothing read
        ends: list[int] = [-1, -1]
        for piece, (code, _) in vocabulary.pieces.items():
            state = 1
            for x in piece.encode():
                new = steps[state].get(x)
                if new is None:
                    new = steps[state][x] = len(steps)
                    steps.append({})
                    ends.append(-1)
                state = new
            ends[state] = code
        # The trie's edges, sorted by (state, byte): most states have one or two.
        edges = sorted((state * 256 + x, to) for state, after in enumerate(steps) for x, to in after.items())
        self.edge = np.array([e for e, _ in edges] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.edge_to = np.array([t for _, t in edges] + [0], dtype=np.int64)
        self.ends = np.array(ends, dtype=np.int64)
        self.piece_logp = np.zeros(len(vocabulary.bytes_of))
        for code, lp in vocabulary.pieces.values():
            self.piece_logp[code] = lp
        self.spelt: list[tuple] = []  # id sequences of characters without a piece
        self.spelt_of: dict[tuple, int] = {}
        self.row = np.empty(1 << 16, dtype=np.int32)  # row of each unit's lattice
        self.first = np.empty(1 << 16, dtype=np.int32)
        self.back = np.empty(1 << 16)
        self.upto = np.empty(1 << 18)
        self.logp = np.empty(1 << 18)
        self.to = np.empty(1 << 18, dtype=np.int32)
        self.code = np.empty(1 << 18, dtype=np.int32)
        self.clear()

    def clear(self):
        """Forget all units; the arrays are written over."""
        import numpy as np

        self.unit: dict[str, int] = defaultdict(count().__next__)  # number of each unit
        self.units, self.rows, self.size = 0, 0, 0
        self.link = np.array([np.iinfo(np.int64).max])
        self.link_row = np.zeros(1, dtype=np.int32)

    def _spell(self, ids: tuple) -> int:
        if ids not in self.spelt_of:
            self.spelt_of[ids] = len(self.v.bytes_of) + len(self.spelt)
            self.spelt.append(ids)
        return self.spelt_of[ids]

    def _grow(self, name: str, end: int):
        import numpy as np

        old = getattr(self, name)
        if end > len(old):
            grown = np.empty(max(end, len(old) + len(old) // 2), dtype=old.dtype)
            grown[:len(old)] = old
            setattr(self, name, grown)
        return getattr(self, name)

    def _rests(self, point, chars, end):
        """Rows of the rests at each character of some units (``point``: their characters one after
        the other); for the new rows, which stand by length, a place of each and the number of each
        length. New pairs go into ``link``."""
        import numpy as np

        at = np.empty(len(point), dtype=np.int32)
        last = end[np.argsort(-chars)]
        longer = len(chars) - np.concatenate([[0], np.cumsum(np.bincount(chars))])  # units of at least n characters
        now = np.full(len(chars), -1, dtype=np.int64)
        places, pairs, each, rows = [], [], [], self.rows
        known = (self.rows + 1) << 21  # pairs from here on go on with a new row
        for n in range(1, len(longer) - 1):
            place = last[:longer[n]] - n
            pair = (now[:len(place)] + 1) << 21 | point[place]
            order = np.argsort(pair)
            pair = pair[order]
            head = np.ones(len(pair), dtype=bool)
            np.not_equal(pair[1:], pair[:-1], out=head[1:])
            heads = np.flatnonzero(head)
            some = pair[heads]
            row = np.full(len(some), -1, dtype=np.int64)
            old = some[:np.searchsorted(some, known)]
            if len(old):
                where = np.searchsorted(self.link, old)
                row[:len(old)] = np.where(self.link[where] == old, self.link_row[where], -1)
            fresh = np.flatnonzero(row < 0)
            row[fresh] = np.arange(rows, rows + len(fresh))
            rows += len(fresh)
            now = np.empty(len(pair), dtype=np.int64)
            now[order] = row[np.cumsum(head) - 1]
            at[place] = now
            places.append(place[order[heads[fresh]]])
            pairs.append(some[fresh])
            each.append(len(fresh))
        pair = np.concatenate(pairs)
        order = np.argsort(pair)
        where = np.searchsorted(self.link, pair[order])
        self.link = np.insert(self.link, where, pair[order])
        self.link_row = np.insert(self.link_row, where, self.rows + order)
        return at, np.concatenate(places), np.array(each)

    def store(self):
        """Make the rows and arcs of the units met since, and their probabilities."""
        import numpy as np

        units = list(islice(reversed(self.unit), len(self.unit) - self.units))[::-1]
        if not units:
            return
        text = "".join(units)
        data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        char_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # bytes where characters begin
        chars = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        unit_end = np.cumsum(chars)
        at, place, each = self._rests(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32), chars, unit_end)
        self._grow("row", len(self.unit))[self.units:len(self.unit)] = at[unit_end - chars]
        self.units = len(self.unit)
        new = len(place)
        if not new:
            return
        end = place + np.repeat(np.arange(1, len(each) + 1), each)
        # Walk all new rows through the trie together; each end of a piece is an arc.
        number_of = np.empty(len(data) + 1, dtype=np.int64)  # character of a byte place where one begins
        number_of[char_at] = np.arange(len(char_at))
        live, byte = np.arange(new), char_at[place]
        stop = char_at[end]
        state = np.ones(new, dtype=np.int64)
        found, single = [], np.zeros(new, dtype=bool)
        while len(live):
            step = state * 256 + data[byte]
            edge = np.searchsorted(self.edge, step)
            state = np.where(self.edge[edge] == step, self.edge_to[edge], 0)
            byte = byte + 1
            code = self.ends[state]
            hit = np.flatnonzero(code >= 0)
            if len(hit):
                to = number_of[byte[hit]]
                dest = np.where(byte[hit] == stop[live[hit]], -1, at[np.minimum(to, len(at) - 1)])
                found.append((live[hit], dest, code[hit], self.piece_logp[code[hit]]))
                single[live[hit]] |= to == place[live[hit]] + 1
            on = np.flatnonzero((state > 0) & (byte < stop[live]))
            live, byte, state = live[on], byte[on], state[on]
        bare = np.flatnonzero(~single)
        if len(bare):  # characters without a piece of their own: their bytes
            spelt = [tuple([self.v.byte_ids[x] for x in text[int(p)].encode("utf-8", "replace")]) for p in place[bare]]
            after = np.minimum(place[bare] + 1, len(at) - 1)
            found.insert(0, (bare, np.where(place[bare] + 1 == end[bare], -1, at[after]),
                             np.array([i[0] if len(i) == 1 else self._spell(i) for i in spelt]),
                             np.array([self.v.rare * len(i) for i in spelt])))
        arcs_of = np.zeros(new, dtype=np.int64)
        for owner, *_ in found:
            arcs_of[owner] += 1
        first = np.cumsum(arcs_of) - arcs_of
        n = int(arcs_of.sum())
        to, code, lp = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int32), np.empty(n)
        free = first + arcs_of  # the arcs of a row are filled from the back
        for owner, dest, c, piece_lp in found:
            free[owner] -= 1
            slot = free[owner]
            to[slot], code[slot], lp[slot] = dest, c, piece_lp
        # Backward sums, one length of rest after the other.
        back = self._grow("back", self.rows + new)
        lp *= self.alpha
        cuts = np.unique(np.concatenate([[0], np.cumsum(each)]))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            a, z = int(first[x]), int(first[y]) if y < new else n
            score = lp[a:z] + np.where(to[a:z] < 0, 0.0, back[to[a:z]])
            heads = first[x:y] - a
            top = np.maximum.reduceat(score, heads)
            arcs = arcs_of[x:y]
            total = top + np.log(np.add.reduceat(np.exp(score - np.repeat(top, arcs)), heads))
            back[self.rows + x:self.rows + y] = total
            lp[a:z] = score - np.repeat(total, arcs)
        np.minimum(lp, 0.0, out=lp)
        # Running probabilities row by row, so that no other unit's rounding gets in.
        upto, p = np.empty(n), np.exp(lp)
        total, some = np.zeros(new), np.arange(new)
        for i in range(int(arcs_of.max())):
            some = some[arcs_of[some] > i]
            total[some] += p[first[some] + i]
            upto[first[some] + i] = total[some]
        upto[first + arcs_of - 1] = 2.0  # the last arc takes what rounding leaves
        self._grow("first", self.rows + new)[self.rows:self.rows + new] = self.size + first
        for name, rows in (("upto", upto), ("logp", lp), ("to", to), ("code", code)):
            self._grow(name, self.size + n)[self.size:self.size + n] = rows
        self.rows += new
        self.size += n

    def starts(self, text: str):
        """Numbers of the units of a normalised text (their rows are known after :meth:`store`)."""
        import numpy as np

        blocks, found = [], iter(self.v.cut(text))
        while units := list(islice(found, 1 << 18)):
            blocks.append(np.fromiter(map(self.unit.__getitem__, units), dtype=np.int64, count=len(units)))
        return np.concatenate(blocks) if blocks else np.empty(0, dtype=np.int64)


def _mix(x):
    """Uniform numbers in (0, 1) from 64-bit counters (splitmix64)."""
    import numpy as np

    x = x * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(11)
    u = x.astype(np.float64)
    u += 0.5
    u *= 2.0 ** -53
    return u


def _of_unit(key, unit):
    """The part of a counter that a unit's draws share."""
    import numpy as np

    with np.errstate(over="ignore"):
        return key + unit.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)


def _counter(of_unit, sample: int, stream: int, step):
    import numpy as np

    with np.errstate(over="ignore"):
        return of_unit + np.uint64(sample * 8 + stream) * np.uint64(0xD1342543DE82EF95) + step.astype(np.uint64) * np.uint64(_STEP)


def _truncated(location, bound, u):
    """Gumbel values of these locations, given that they are below ``bound``."""
    import numpy as np

    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        v = location - np.log(np.exp(location - bound) - np.log(u))
    return np.where(np.isneginf(location), _NEVER, np.minimum(v, bound))


def _roll(lat: Lattices, node, of_unit, step, sample: int):
    """Follow winning arcs from each node to its unit's end.

    ``node`` (-1: already there), ``of_unit`` (the unit's part of the counters) and ``step`` (arcs
    already taken in the unit) are arrays over units in text order. Gives the arcs in that order,
    with the index into ``node`` and the step of each, and the number of arcs of each unit."""
    import numpy as np

    live = np.flatnonzero(node >= 0)
    now = node[live]
    counter = _counter(of_unit[live], sample, 0, step[live])
    got = []
    length = np.zeros(len(node), dtype=np.int64)
    while len(live):
        u = _mix(counter)
        arc = lat.first.take(now).astype(np.int64)
        over = np.flatnonzero(u >= lat.upto.take(arc))
        while len(over):
            arc[over] += 1
            over = over[u[over] >= lat.upto.take(arc[over])]
        got.append((live, arc))
        length[live] = len(got)
        now = lat.to.take(arc)
        on = np.flatnonzero(now >= 0)
        live, now, counter = live[on], now[on], counter[on]
        counter += np.uint64(_STEP)
    begin = np.cumsum(length) - length
    arcs = np.empty(int(length.sum()), dtype=np.int64)
    for place, (idx, arc) in enumerate(got):
        arcs[begin[idx] + place] = arc
    of = np.repeat(np.arange(len(node)), length)
    return arcs, of, np.arange(len(arcs)) - (begin - step)[of], length


def sample_paths(lat: Lattices, starts: list, keys: list[int], k: int) -> list[list[tuple]]:
    """For each text: up to k tuples (arcs, log probability, perturbed value, log inclusion).

    ``starts`` has the texts' unit lattices, ``keys`` their 64-bit random keys. The inclusion score
    of a path is the chance that its perturbed value exceeds the (k+1)-th of the text."""
    import numpy as np

    texts = len(starts)
    done: list[list] = [[] for _ in range(texts)]
    frontier: list[list] = [[] for _ in range(texts)]  # (value, source sample, place, prefix log p, excluded arcs)
    key_of = np.array(keys, dtype=np.uint64)
    # Texts without a unit have the one empty segmentation.
    todo = [(i, None) for i in range(texts) if len(starts[i])]
    for i in range(texts):
        if not len(starts[i]):
            done[i].append({"arcs": np.empty(0, dtype=np.int64), "logp": 0.0, "value": 0.0})
    for s in range(k):
        if not todo:
            break
        nodes, units, steps, keys_, texts_, heads = [], [], [], [], [], []
        # The single draws of all texts at once: of the roots, or of the sets opened.
        some = key_of[[i for i, _ in todo]]
        if s == 0:
            roots = -np.log(-np.log(_mix(_counter(some, 0, 2, np.zeros(len(todo))))))
            nodes.append(np.concatenate([starts[i] for i, _ in todo]).astype(np.int64))
            texts_ = [len(starts[i]) for i, _ in todo]
            ends = np.cumsum(texts_)
            units.append(np.arange(ends[-1]) - np.repeat(ends - texts_, texts_))
            steps.append(np.zeros(ends[-1], dtype=np.int64))
            keys_.append(np.repeat(some, texts_))
            none = np.empty(0, dtype=np.int64)
            heads = [{"arcs": none, "units": none, "steps": none, "logp": 0.0, "value": x} for x in roots.tolist()]
        else:
            at_unit, at_step = (np.array([done[i][o[1]][x][o[2]] for i, o in todo]) for x in ("units", "steps"))
            picks, rests = (_mix(_counter(_of_unit(some, at_unit), s, stream, at_step)) for stream in (3, 4))
        for t, (i, opened) in enumerate(todo if s else []):
            value, source, place, prefix, excluded = opened
            path = done[i][source]
            at = int(path["arcs"][place])
            unit0, step0 = int(path["units"][place]), int(path["steps"][place])
            origin = starts[i][unit0] if step0 == 0 else lat.to[path["arcs"][place - 1]]
            a = int(lat.first[origin])
            b = a
            while lat.upto[b] < 2.0:
                b += 1
            free = [x for x in range(a, b + 1) if x not in excluded]
            p = np.exp(lat.logp[free])
            u = picks[t]
            pick = free[min(int(np.searchsorted(np.cumsum(p), u * p.sum(), side="right")), len(free) - 1)]
            # What is left of the set, below the path's value.
            rest = [x for x in free if x != pick]
            if rest:
                loc = prefix + math.log(np.exp(lat.logp[rest]).sum())
                left = float(_truncated(np.array([loc]), value, rests[t:t + 1])[0])
                frontier[i].append((left, source, place, prefix, excluded | {pick}))
            head = {"arcs": np.append(path["arcs"][:place], pick), "units": path["units"][:place + 1],
                    "steps": path["steps"][:place + 1], "logp": prefix + float(lat.logp[pick]), "value": value}
            node = np.concatenate([[lat.to[pick]], starts[i][unit0 + 1:]]).astype(np.int64)
            unit = np.arange(unit0, len(starts[i]))
            step = np.zeros(len(unit), dtype=np.int64)
            step[0] = step0 + 1
            heads.append(head)
            nodes.append(node)
            units.append(unit)
            steps.append(step)
            keys_.append(np.full(len(node), key_of[i]))
            texts_.append(len(node))
        node, unit, step, key = map(np.concatenate, (nodes, units, steps, keys_))
        of_unit = _of_unit(key, unit)
        arcs, of, at, length = _roll(lat, node, of_unit, step, s)
        bounds = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(texts_)])]
        count = np.diff(bounds)
        lp = lat.logp.take(arcs)
        base = np.array([h["logp"] for h in heads])
        value = np.array([h["value"] for h in heads])
        # Log probabilities up to and with each arc, text by text.
        run = np.empty(len(lp))
        for x, a, b in zip(base.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            np.cumsum(lp[a:b], out=run[a:b])
            run[a:b] += x
        prefix = run - lp
        with np.errstate(divide="ignore"):
            loc = prefix + np.log(-np.expm1(lp))
        u = _mix(_counter(of_unit[of], s, 1, at))  # one draw for each set left behind
        v = _truncated(loc, np.repeat(value, count), u)
        full = np.flatnonzero(count)
        total = base.copy()
        total[full] = run[bounds[1:][full] - 1]
        unit_of = unit[of]
        best: list[list] = [[] for _ in todo]
        for _ in range(k - s):  # the largest sets of each path, one after another: as many as are kept below
            if not len(full):
                break
            top = np.maximum.reduceat(v, bounds[:-1][full])
            place = np.flatnonzero((v == np.repeat(top, count[full])) & (v > _NEVER)) if len(v) else np.empty(0, int)
            of_text = np.searchsorted(bounds, place, side="right") - 1
            for x, n, val in zip(place.tolist(), of_text.tolist(), v[place].tolist()):
                best[n].append((x, val))
            if not len(place):
                break
            v[place] = _NEVER
        following = []
        for n, (i, _) in enumerate(todo):
            a, b = int(bounds[n]), int(bounds[n + 1])
            head = heads[n]
            offset = len(head["arcs"])
            made = {"arcs": arcs[a:b], "units": unit_of[a:b], "steps": at[a:b]}
            if offset:
                made = {x: np.concatenate([head[x], y]) for x, y in made.items()}
            path = made | {"logp": float(total[n]), "value": head["value"]}
            done[i].append(path)
            for x, val in best[n]:
                frontier[i].append((val, len(done[i]) - 1, x - a + offset, float(prefix[x]), frozenset([int(arcs[x])])))
            frontier[i].sort(key=lambda f: -f[0])
            del frontier[i][k - s:]  # as many paths are to come, and one value more
            if s + 1 < k and frontier[i] and frontier[i][0][0] > _NEVER:
                following.append((i, frontier[i].pop(0)))
        todo = following
    out = []
    for i in range(texts):
        bound = frontier[i][0][0] if frontier[i] else _NEVER
        rows = []
        for path in done[i]:
            x = path["logp"] - bound if bound > _NEVER else math.inf
            inclusion = 0.0 if x > 4 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))
            rows.append((path["arcs"], path["logp"], path["value"], inclusion))
        out.append(rows)
    return out


def _all_ids(lat: Lattices, paths: list):
    """Piece ids of several paths, one after the other, and their numbers."""
    import numpy as np

    counts = np.array(list(map(len, paths)), dtype=np.int64)
    codes = lat.code[np.concatenate(paths)] if paths else np.empty(0, dtype=np.int32)
    n = len(lat.v.bytes_of)
    if not len(codes) or codes.max() < n:
        return codes.astype(np.int32), counts
    parts = [_ids(lat, p) for p in paths]
    return np.concatenate(parts), np.array(list(map(len, parts)), dtype=np.int64)


def _ids(lat: Lattices, arcs):
    """Piece ids of a path."""
    import numpy as np

    codes = lat.code[arcs]
    n = len(lat.v.bytes_of)
    if not len(codes) or codes.max() < n:
        return codes.astype(np.int32)
    return np.array([i for c in codes.tolist() for i in (lat.spelt[c - n] if c >= n else (c,))], dtype=np.int32)


def sample_segmentations(docs: DataFrame, id_col: str, text_col: str, model: bytes, k: int = 2,
                         alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, rank, ids, n_pieces, log_prob, perturbed, log_inclusion, round_trip).

    Up to ``k`` distinct segmentations of every text, by falling perturbed value (rank from 1);
    all of them where there are fewer. ``log_inclusion`` is the log of the chance that this
    segmentation's perturbed value exceeds the (k+1)-th largest one; ``round_trip`` is whether its
    ids decode to the text. A text that
    holds the blank mark itself does not, since the model has one piece for both. Null and empty
    texts have one segmentation of no pieces. A row's random
    key is the hash of its id (as text; null: the empty text) and ``seed``: repeated rows get equal
    samples. Other columns, whatever their names, are not read; an empty table gives an empty
    result. Whole texts are taken; memory grows with the longest text, not with the table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"),
                       F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)).alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = (f"id {kind}, rank int, ids array<int>, n_pieces bigint, log_prob double, perturbed double, "
              "log_inclusion double, round_trip boolean")

    def sample(batches):
        import numpy as np
        import pyarrow as pa

        lat = worker_state("segmentation", "lattices", (hash(shared.value), alpha), lambda: Lattices(Vocabulary(shared.value), alpha))

        def emit(ids, keys, texts, starts):
            lat.store()
            found = sample_paths(lat, [lat.row[x] for x in starts], keys, k)
            take = [i for i, paths in enumerate(found) for _ in paths]
            flat, counts = _all_ids(lat, [p[0] for paths in found for p in paths])
            sizes = np.concatenate([[0], np.cumsum(counts)])
            decoded = lat.v.decode_all(flat, sizes)
            columns = [(rank, n, logp, value, inclusion, text == texts[i]) for (i, rank, logp, value, inclusion), n, text in zip(
                ((i, rank, *p[1:]) for i, paths in enumerate(found) for rank, p in enumerate(paths, 1)), counts.tolist(), decoded, strict=True)]
            column = lambda j, t: pa.array([c[j] for c in columns], t)
            lists = pa.ListArray.from_arrays(pa.array(np.array(sizes, dtype=np.int32)),
                                             pa.array(flat))
            if lat.size > ARCS_KEPT:
                lat.clear()
            return pa.RecordBatch.from_arrays(
                [ids.take(pa.array(take, pa.int64())), column(0, pa.int32()), lists, column(1, pa.int64()),
                 column(2, pa.float64()), column(3, pa.float64()), column(4, pa.float64()), column(5, pa.bool_())],
                names=["id", "rank", "ids", "n_pieces", "log_prob", "perturbed", "log_inclusion", "round_trip"])

        # Nothing here makes cycles, and the collector would go through the tables again and again.
        gc.disable()
        try:
            for batch in sliced(batches, ROWS_TOGETHER):
                ids, all_keys, all_texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
                from_, starts, units = 0, [], 0
                for i, text in enumerate(all_texts):
                    starts.append(lat.starts(lat.v.normalise(text)) if text else np.empty(0, dtype=np.int64))
                    units += len(starts[-1])
                    if units >= UNITS_TOGETHER or i + 1 == len(all_texts):
                        part = slice(from_, i + 1)
                        yield emit(ids[part], [x & (1 << 64) - 1 for x in all_keys[part]], all_texts[part], starts)
                        from_, starts, units = i + 1, [], 0
        finally:
            gc.enable()

    return rows.mapInArrow(sample, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ids_col: str, out_col: str, model: bytes) -> DataFrame:
    """``rows`` with the text of the ids in ``ids_col`` as ``out_col``; null ids give null."""
    import pandas as pd
    from pyspark.sql import types as T

    shared = rows.sparkSession.sparkContext.broadcast(model)

    def texts(ids):
        v = worker_state("segmentation", "vocabulary", hash(shared.value), lambda: Vocabulary(shared.value))
        return pd.Series([None if x is None else v.decode(x) for x in ids], dtype=object)

    return rows.withColumn(out_col, F.pandas_udf(texts, T.StringType())(F.col(ids_col)))
