"""Generalised LR repair of sequences of roles, with a graph-structured stack."""

from __future__ import annotations

from array import array
from collections.abc import Iterable

#: What an edit costs; an undeleted truncated row adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Roles that can be inserted or set, by initial.
ROLES = {"u": "user", "a": "assistant"}
#: The grammar of role initials ``(s?(ua)+)?``; C is the start, small letters are roles.
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "Pua"), ("P", "ua"))
#: A top that costs more than this above the cheapest leads to no cheapest repair: from any top, two rows more and one fewer do what another top can do.
SLACK = 2 * INSERT + DELETE

Stack = tuple[int, ...]


class Table:
    """SLR tables of a grammar whose rules have one-letter symbols, and the moves of stacks of states."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        self.rules = (("^", grammar[0][0]), *grammar)
        self.heads = {a for a, _ in self.rules}
        self.follow = self._follow()
        self.items, self.to, todo = [self._closure({(0, 0)})], {}, [0]
        while todo:
            state = todo.pop()
            for x in sorted({body[dot] for r, dot in self.items[state] if dot < len(body := self.rules[r][1])}):
                moved = self._closure({(r, dot + 1) for r, dot in self.items[state] if self.rules[r][1][dot : dot + 1] == x})
                if moved not in self.items:
                    self.items.append(moved)
                    todo.append(len(self.items) - 1)
                self.to[state, x] = self.items.index(moved)

    def _closure(self, items: set) -> frozenset:
        out, todo = set(items), list(items)
        while todo:
            r, dot = todo.pop()
            head = self.rules[r][1][dot : dot + 1]
            for k, (a, _) in enumerate(self.rules):
                if a == head and (k, 0) not in out:
                    out.add((k, 0))
                    todo.append((k, 0))
        return frozenset(out)

    def _follow(self) -> dict[str, set[str]]:
        """What can stand after each head; rounds go on until no set grows."""
        first = {a: set() for a in self.heads}  # with "" for heads that can be empty
        out = {a: set() for a in self.heads}
        out["^"] = {"$"}

        def of(symbols: str) -> set[str]:
            found = {""}
            for x in symbols:
                found = (found - {""}) | (first[x] if x in self.heads else {x})
                if "" not in found:
                    break
            return found

        size = -1
        while size != (size := sum(map(len, (*first.values(), *out.values())))):
            for a, body in self.rules:
                first[a] |= of(body)
                for k, x in enumerate(body):
                    if x in self.heads:
                        out[x] |= of(body[k + 1 :]) - {""} | (out[a] if "" in of(body[k + 1 :]) else set())
        return out

    def _reduced(self, stack: Stack, ahead: str) -> set[Stack]:
        """Stacks reachable by reductions when ``ahead`` comes next ("$": the end), itself among them."""
        out, todo = set(), [stack]
        while todo:
            now = todo.pop()
            if now in out:
                continue
            out.add(now)
            for r, dot in self.items[now[-1]]:
                a, body = self.rules[r]
                if r and dot == len(body) and ahead in self.follow[a]:
                    below = now[: len(now) - len(body)]
                    todo.append((*below, self.to[below[-1], a]))
        return out

    def shift(self, stack: Stack, role: str) -> set[Stack]:
        moved = {(*s, self.to[s[-1], role]) for s in self._reduced(stack, role) if (s[-1], role) in self.to}
        return {self._settled(s) for s in moved}

    def _settled(self, stack: Stack) -> Stack:
        """The stack after reductions without an alternative, so that stacks of one meaning are equal."""
        while len(self.items[stack[-1]]) == 1:
            (r, dot), = self.items[stack[-1]]
            a, body = self.rules[r]
            if dot < len(body) or not r:
                break
            below = stack[: len(stack) - len(body)]
            stack = (*below, self.to[below[-1], a])
        return stack

    def accepts(self, stack: Stack) -> bool:
        return any(self.items[s[-1]] >= {(0, 1)} for s in self._reduced(stack, "$"))


class Repairer:
    """Cheapest edits of role sequences; ties go to the ASCII-least audit of edit initials.

    The tops of the stack graph after some rows are stacks of LR states. Equal
    stacks are merged, and the one with the least (cost, audit) stays. Audits of
    tops end with the edit of the same row, so none begins another, and their order
    does not change however they go on: a rank stands for each. What follows
    from a set of tops (relative costs, in order of rank) and a row is worked out once.
    """

    def __init__(self, table: Table | None = None):
        self.table = table or Table()
        self.start = (((0,), 0),)
        self.ids, self.configs = {self.start: 0}, [self.start]
        self.steps, self.known = [], {}
        self.ends = {}

    def _inserted(self, stack: Stack) -> dict[Stack, int]:
        """Stacks that inserted rows lead to, by their least number."""
        out, todo = {stack: 0}, [stack]
        for now in todo:
            for role in ROLES:
                for to in sorted(self.table.shift(now, role)):
                    if to not in out:
                        out[to] = out[now] + 1
                        todo.append(to)
        return out

    def step(self, config: int, initial: str, fault: str) -> int:
        """The step (an index) from a set of tops over a row; fault is ``delete``, ``truncated`` or empty."""
        key = (config, initial, fault)
        if key in self.known:
            return self.known[key]
        best: dict[Stack, tuple[int, int, str]] = {}

        def offer(stack: Stack, cost: int, rank: int, letters: str) -> None:
            best[stack] = min(best.get(stack, (cost, rank, letters)), (cost, rank, letters))

        for rank, (top, cost) in enumerate(self.configs[config]):
            for stack, n in self._inserted(top).items():
                before, letters = cost + n * INSERT, "I" * n
                offer(stack, before + DELETE, rank, letters + "D")
                if fault == "delete":
                    continue
                more = before + (TRUNCATED if fault else 0)
                for to in self.table.shift(stack, initial):
                    offer(to, more + KEEP, rank, letters + "K")
                for role in ROLES:
                    for to in self.table.shift(stack, role):
                        offer(to, more + REROLE, rank, letters + "R")
        least = min(cost for cost, _, _ in best.values())
        kept = sorted((rank, letters, stack, cost - least) for stack, (cost, rank, letters) in best.items() if cost - least <= SLACK)
        after = tuple((stack, cost) for _, _, stack, cost in kept)
        if after not in self.ids:
            self.ids[after] = len(self.configs)
            self.configs.append(after)
        self.steps.append((self.ids[after], least, [(rank, letters) for rank, letters, _, _ in kept]))
        self.known[key] = len(self.steps) - 1
        return self.known[key]

    def end(self, config: int) -> tuple[int, int, str]:
        """(cost, rank, inserted rows) of the cheapest way from a set of tops to an accepted end."""
        if config not in self.ends:
            self.ends[config] = min((cost + n * INSERT, rank, "I" * n) for rank, (top, cost) in enumerate(self.configs[config]) for stack, n in self._inserted(top).items() if self.table.accepts(stack))
        return self.ends[config]

    def audit(self, steps: array) -> tuple[int, str]:
        """(cost, audit) of the steps taken over all rows."""
        total, config = 0, 0
        for k in steps:
            config = self.steps[k][0]
            total += self.steps[k][1]
        cost, rank, last = self.end(config)
        out = [last]
        for k in reversed(steps):
            rank, letters = self.steps[k][2][rank]
            out.append(letters)
        return total + cost, "".join(reversed(out))


def repaired(audit: str, rows: Iterable[tuple[str, str]]) -> Iterable[tuple[str, str]]:
    """(role, text) rows after the edits of an audit."""
    rows, awaits = iter(rows), "u"
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = ROLES[awaits]
        if not role.startswith("s"):
            awaits = "a" if awaits == "u" else "u"
        yield role, text
