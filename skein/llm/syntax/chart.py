"""Chart parsing over token classes, exact and with minimum-cost error correction."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np

_PART = re.compile(r"\s*('[^']*'|[A-Za-z_{}][\w{}]*|[()|?*+])")


class Grammar:
    """Context-free grammar from lines `Name = alternatives`; quoted or undefined names are terminals; ? * + and groups
    are turned into helper rules. Loops become left recursion, which a chart handles in linear time."""

    def __init__(self, text: str):
        self.lhs: list[str] = []
        self.rhs: list[tuple[str, ...]] = []
        self.rules: dict[str, list[int]] = defaultdict(list)
        defs = {}
        for line in re.sub(r"\n[ \t]+", " ", text.strip()).split("\n"):
            if "=" in line:
                name, _, body = line.partition(" = ")
                defs[name.strip()] = body
        self.names = set(defs)
        for name, body in defs.items():
            self._tokens = _PART.findall(body)
            self._at = 0
            for alt in self._alternatives(name):
                self._add(name, alt)
        self._prepare()

    def _add(self, name: str, symbols: tuple[str, ...]) -> None:
        self.rules[name].append(len(self.lhs))
        self.lhs.append(name)
        self.rhs.append(symbols)

    def _alternatives(self, name: str) -> list[tuple[str, ...]]:
        alts, now = [], []
        while self._at < len(self._tokens):
            t = self._tokens[self._at]
            if t == ")":
                break
            self._at += 1
            if t == "|":
                alts.append(tuple(now))
                now = []
                continue
            if t == "(":
                inner = self._alternatives(name)
                self._at += 1
                symbol = self._fresh(name)
                for alt in inner:
                    self._add(symbol, alt)
            else:
                symbol = t.strip("'")
            if self._at < len(self._tokens) and self._tokens[self._at] in "?*+":
                mark = self._tokens[self._at]
                self._at += 1
                loop = self._fresh(name)
                if mark == "?":
                    self._add(loop, ())
                    self._add(loop, (symbol,))
                else:
                    self._add(loop, () if mark == "*" else (symbol,))
                    self._add(loop, (loop, symbol))
                symbol = loop
            now.append(symbol)
        alts.append(tuple(now))
        return alts

    def _fresh(self, name: str) -> str:
        symbol = f"{name}~{len(self.names)}"
        self.names.add(symbol)
        return symbol

    def _prepare(self) -> None:
        nullable: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in self.names}
        changed = True
        while changed:
            changed = False
            for l, r in zip(self.lhs, self.rhs):
                before = len(first[l]), l in nullable
                for s in r:
                    if s not in self.names:
                        first[l].add(s)
                        break
                    first[l] |= first[s]
                    if s not in nullable:
                        break
                else:
                    nullable.add(l)
                changed |= before != (len(first[l]), l in nullable)
        self.nullable, self._first = nullable, first
        # Terminals that stand in the same places of the same rules can be exchanged for each other.
        places: dict[str, set] = defaultdict(set)
        for l, r in zip(self.lhs, self.rhs):
            for k, s in enumerate(r):
                if s not in self.names:
                    places[s].add((l, r[:k], r[k + 1 :]))
        alike: dict[frozenset, str] = {}
        self._class = {s: alike.setdefault(frozenset(c), s) for s, c in sorted(places.items())}
        self._first_of = []
        for r in self.rhs:
            have: set[str] = set()
            for s in r:
                if s not in self.names:
                    have.add(s)
                    break
                have |= first[s]
                if s not in nullable:
                    break
            else:
                have.add("")
            self._first_of.append(have)
        self._predicted: dict[tuple[str, str], list[int]] = {}

    def _predict(self, name: str, look: str) -> list[int]:
        key = (name, look)
        if key not in self._predicted:
            self._predicted[key] = [p for p in self.rules[name] if look in self._first_of[p] or "" in self._first_of[p]]
        return self._predicted[key]

    def classes(self, tokens: tuple[str, ...]) -> tuple[str, ...]:
        """The tokens with one name for all terminals that the grammar does not tell apart."""
        name = self._class.get
        return tuple([name(t, t) for t in tokens])

    def parse(self, start: str, tokens: tuple[str, ...]) -> int:
        """-1 if the tokens derive from start, else the index of the first token that no derivation can take."""
        n, names, rhs, lhs, nullable = len(tokens), self.names, self.rhs, self.lhs, self.nullable
        waits: list[dict] = []
        kernel: list[tuple] = [(p, 0, 0) for p in self._predict(start, tokens[0] if n else "$")]
        for i in range(n + 1):
            look = tokens[i] if i < n else "$"
            wait: dict[str, list] = {}
            waits.append(wait)
            done: set[str] = set()
            seen = set(kernel)
            stack, following, accepted = kernel, [], False
            while stack:
                item = stack.pop()
                p, d, o = item
                r = rhs[p]
                if d == len(r):
                    name = lhs[p]
                    if o == 0 and name == start:
                        accepted = True
                    if o == i:
                        done.add(name)
                    for q, e, u in waits[o].get(name, ()):
                        new = (q, e + 1, u)
                        if new not in seen:
                            seen.add(new)
                            stack.append(new)
                    continue
                s = r[d]
                if s not in names:
                    if s == look:
                        following.append((p, d + 1, o))
                    continue
                if s in wait:
                    wait[s].append(item)
                else:
                    wait[s] = [item]
                    for q in self._predict(s, look):
                        new = (q, 0, i)
                        if new not in seen:
                            seen.add(new)
                            stack.append(new)
                if s in nullable or s in done:
                    new = (p, d + 1, o)
                    if new not in seen:
                        seen.add(new)
                        stack.append(new)
            if i == n:
                return -1 if accepted else n
            if not following:
                return i
            kernel = following
        return n

    def repair_cost(self, start: str, tokens: tuple[str, ...], most: int = 3) -> int:
        """Least number of inserted, deleted or replaced tokens that makes the tokens derive from start; most + 1 if
        it exceeds `most`."""
        edits = self.repair(start, tokens, most)
        return most + 1 if edits is None else len(edits)

    def repair(self, start: str, tokens: tuple[str, ...], most: int | None = None) -> tuple[int, ...] | None:
        """Token indexes of a least repair (one index per edit; an insertion stands before its index), or None if it
        takes more than `most` edits. Without `most` a repair is always found: len(tokens) + the shortest text is enough."""
        if self.parse(start, tokens) < 0:
            return ()
        bound = 1
        while most is None or bound <= most:
            edits = self._within(start, tokens, bound)
            if edits is not None:
                return edits
            bound += 1
        return None

    def _within(self, start: str, tokens: tuple[str, ...], bound: int) -> tuple[int, ...] | None:
        """A repair of at most `bound` edits. The chart's columns are pairs (position, edits so far): an edit leads to a
        column of the next layer, and the last layer, which allows no further edit, predicts by the next token only."""
        n, layers = len(tokens), bound + 1
        names, rhs, lhs, nullable, first = self.names, self.rhs, self.lhs, self.nullable, self._first
        table: list[dict] = [{} for _ in range((n + 1) * layers)]
        waits: list[dict] = [{} for _ in range((n + 1) * layers)]
        for p in self.rules[start]:
            table[0][(p, 0, 0)] = ()

        def last(item: tuple, edits: tuple, at: int) -> None:
            """Into the last layer go only items that can take the next token."""
            p, d, _ = item
            r = rhs[p]
            if d < len(r):
                s, look = r[d], tokens[at] if at < n else "$"
                if look not in first[s] and s not in nullable if s in names else s != look:
                    return
            table[at * layers + bound].setdefault(item, edits)

        for column in range((n + 1) * layers):
            i, c = divmod(column, layers)
            here, wait = table[column], waits[column]
            if not here:
                continue
            exact = c == bound
            look = tokens[i] if i < n else "$"
            done: set[str] = set()
            agenda = list(here)
            edit = last if c == bound - 1 else lambda item, edits, at: table[at * layers + c + 1].setdefault(item, edits)  # noqa: B023
            while agenda:
                item = agenda.pop()
                p, d, o = item
                r, edits = rhs[p], here[item]
                if d == len(r):
                    name = lhs[p]
                    if o == column:
                        done.add(name)
                    if o == 0 and name == start and i < n and not exact:
                        edit(item, (*edits, i), i + 1)
                    before, kept = table[o], edits[o % layers :]
                    for w in waits[o].get(name, ()):
                        new = (w[0], w[1] + 1, w[2])
                        if new not in here:
                            here[new] = before[w] + kept
                            agenda.append(new)
                    continue
                s = r[d]
                moved = (p, d + 1, o)
                if s in names:
                    if s in wait:
                        wait[s].append(item)
                    else:
                        wait[s] = [item]
                        for q in self._predict(s, look) if exact else self.rules[s]:
                            new = (q, 0, column)
                            if new not in here:
                                here[new] = edits
                                agenda.append(new)
                    if (s in nullable or s in done) and moved not in here:
                        here[moved] = edits
                        agenda.append(moved)
                    continue
                if s == look and i < n:
                    table[column + layers].setdefault(moved, edits)
                if not exact:
                    more = (*edits, i)
                    edit(moved, more, i)
                    if i < n:
                        edit(moved, more, i + 1)
                        edit(item, more, i + 1)
        for c in range(layers):
            for (p, d, o), edits in table[n * layers + c].items():
                if o == 0 and lhs[p] == start and d == len(rhs[p]):
                    return edits
        return None


PAIRS = {"(": ")", "[": "]", "{": "}"}
_MATCH = PAIRS | {z: a for a, z in PAIRS.items()}


#: Brackets from which the rows of the bracket chart are packed; below, all of them take 64 MB at most.
UNPACKED = 8192


class _Rows:
    """Costs of all stretches [a, z) by a, from z = a on. Each differs from the next by 1 at most, so the rows of a long
    text are kept as two bits a step, n * n / 8 bytes in all."""

    def __init__(self, n: int):
        self.dtype = np.int16 if n < 2**15 else np.int32
        self._packed = n >= UNPACKED
        self._rows: list = [None] * (n + 1)

    def __setitem__(self, a: int, row: np.ndarray) -> None:
        steps = np.diff(row) if self._packed else row
        self._rows[a] = (len(steps), np.packbits(steps > 0), np.packbits(steps < 0)) if self._packed else row

    def __getitem__(self, a: int) -> np.ndarray:
        if not self._packed:
            return self._rows[a]
        n, up, down = self._rows[a]
        row = np.zeros(n + 1, self.dtype)
        row[1:] = np.cumsum(np.unpackbits(up, count=n).view(np.int8) - np.unpackbits(down, count=n).view(np.int8))
        return row


def unpaired(brackets: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The brackets without adjacent matching pairs, which never cost anything."""
    rest: list[tuple[str, int]] = []
    for b in brackets:
        if rest and PAIRS.get(rest[-1][0]) == b[0]:
            rest.pop()
        else:
            rest.append(b)
    return rest


def _shortened(rest: list[tuple[str, int]], own: set[str]) -> tuple[list[tuple[str, int]], list[int]]:
    """The brackets without pairs of neighbours that can be made to match each other, and the places of these edits.

    A run of equal brackets of `own` with n matching ones before it (those without any count as equal) is shortened to
    3 n + 4 or one less: in some least repair no more of a run are apart from a pair within it. n have matching partners;
    in each of the n + 1 gaps between these two pair at an edit each, as of more of them two could pair with each other and
    their partners too; one pairs towards the other side, and one is deleted.
    """
    seen: Counter[str] = Counter()
    keys: list[tuple[str, int] | None] = []
    for b, _ in rest:
        n = seen[_MATCH[b]]
        keys.append((b if n else "", n) if b in own else None)
        seen[b] += 1
    kept, edited, a = [], [], 0
    for key, run in groupby(keys):
        z = a + len(list(run))
        cut = a + (max(z - a - 3 * key[1] - 3, 0) // 2 * 2 if key else 0)
        edited += [i for _, i in rest[a:cut:2]]
        kept += rest[cut:z]
        a = z
    return kept, edited


def bracket_repair(brackets: list[tuple[str, int]]) -> tuple[int, list[int]]:
    """Least edits that balance the brackets (text, token index), and the indexes of the edited ones; exact at any length.

    Adjacent matching pairs are dropped, and long runs shortened by pairs that cost an edit each (`_shortened`).
    An interval chart over the others gives the cost: the first bracket is deleted, or has a partner m that splits the
    stretch. Only an m that makes the stretch up to it cheaper than deletion and earlier partners do is a partner worth
    trying further on, as a stretch never costs more than its parts; each is tried for all ends at once.
    """
    rest = unpaired(brackets)
    edited, length = [], -1
    while length != len(rest):
        length = len(rest)
        for own in (set(PAIRS), set(PAIRS.values())):  # openers from the end, closers from the front
            rest, places = _shortened(rest[::-1], own)
            edited += places
    n = len(rest)
    t, at = [b for b, _ in rest], [i for _, i in rest]
    best = _Rows(n)
    best[n] = inner = np.zeros(1, best.dtype)
    pair = {b: np.array([_pair_cost(b, c) for c in t], best.dtype) for b in set(t)}
    partners: list[list[int]] = [[] for _ in t]
    for a in range(n - 1, -1, -1):
        row = np.append(best.dtype(0), inner + best.dtype(1))
        closed = pair[t[a]][a + 1 :] + inner[:-1]
        k = 0
        while k < len(closed):
            better = closed[k:] < row[k + 2 :]
            step = int(better.argmax())
            if not better[step]:
                break
            k += step + 1
            np.minimum(row[k + 1 :], closed[k - 1] + best[a + k + 1], out=row[k + 1 :])
            partners[a].append(a + k)
        best[a] = inner = row
    todo = [(0, n)]
    while todo:
        a, z = todo.pop()
        if a >= z:
            continue
        cost, inside = best[a][z - a], best[a + 1]
        if cost == inside[z - a - 1] + 1:
            edited.append(at[a])
            todo.append((a + 1, z))
            continue
        m = next(m for m in partners[a] if cost == pair[t[a]][m] + inside[m - a - 1] + best[m + 1][z - m - 1])
        if pair[t[a]][m]:
            edited += [at[a]] if t[a] not in PAIRS else []
            edited += [at[m]] if PAIRS.get(t[a]) != t[m] and (t[a] in PAIRS or t[m] in PAIRS) else []
        todo += [(a + 1, m), (m + 1, z)]
    return len(edited), sorted(edited)


def _pair_cost(a: str, b: str) -> int:
    """Replacements that make a and b a matching pair."""
    if PAIRS.get(a) == b:
        return 0
    return 1 if a in PAIRS or b not in PAIRS else 2
