"""Generalised LL recognition with a graph-structured stack, for grammars in extended BNF.

Rules are compiled to slots: match a terminal, call a rule, branch, jump, return. A branch keeps, per next token, only
the ways that can begin with it; where one way is left the parser just goes on, where several are left all are followed,
each with its place in one graph-structured stack. A rule that is called again at the same place is not parsed again:
its callers share the node, and return from each of its ends. So any context-free grammar is recognised, left
recursive and ambiguous ones too, in cubic time at worst and in linear time where one token of lookahead decides.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:('(?:[^']|\\')+')|([A-Za-z_]+)|([:;|()*+?])|(@[\w.]+))")
MATCH, CALL, BRANCH, JUMP, RETURN, GUARD = range(6)
END = "<end>"


class _Node:
    """A rule called at a place by ways of the same dialects: its callers as (slot to return to, caller's node), where it
    ended last, and for which dialects."""

    __slots__ = ("edges", "end", "ended")

    def __init__(self, edges: list) -> None:
        self.edges, self.end, self.ended = edges, -1, 0


class Grammar:
    """`rule : alternatives ;` ...; terminals are 'quoted' or UPPER CASE, rules lower case; ( ) * + ? as usual. `@d` lets
    only dialect d and those after it go on."""

    def __init__(self, text: str, dialects: tuple[str, ...] = ("",)) -> None:
        self.dialects = dialects
        self.kinds: dict[str, int] = {END: 0}
        self.op: list[int] = []
        self.arg: list = []
        rules = self._parse(text)
        self.rule_of = {name: i for i, name in enumerate(rules)}
        self.start: list[int] = []
        self.rule_at: list[int] = []
        for i, (name, tree) in enumerate(rules.items()):
            self.start.append(len(self.op))
            self._emit_alternatives(tree)
            self._add(RETURN, i)
            self.rule_at += [i] * (len(self.op) - len(self.rule_at))
        self._lookahead()

    def _parse(self, text: str) -> dict:
        words, pos = [], 0
        text = re.sub(r"#\s.*", "", text).strip()
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if m is None:
                raise ValueError(f"grammar: {text[pos:pos + 40]!r}")
            words.append(m.group().strip())
            pos = m.end()
        self._words, self._at = words, 0
        rules = {}
        while self._at < len(words):
            name = words[self._at]
            if words[self._at + 1] != ":" or name in rules:
                raise ValueError(f"grammar: rule {name}")
            self._at += 2
            rules[name] = self._alternatives()
            self._at += 1
        return rules

    def _alternatives(self) -> list:
        out = [[]]
        while (w := self._words[self._at]) not in (")", ";"):
            self._at += 1
            if w == "|":
                out.append([])
                continue
            item = (self._alternatives(), self._skip())[0] if w == "(" else w
            if self._words[self._at] in ("*", "+", "?"):
                item = (self._words[self._at], item)
                self._at += 1
            out[-1].append(item)
        return out

    def _skip(self) -> None:
        self._at += 1

    def _add(self, op: int, arg) -> int:
        self.op.append(op)
        self.arg.append(arg)
        return len(self.op) - 1

    def _emit_alternatives(self, ways: list) -> None:
        if len(ways) == 1:
            for item in ways[0]:
                self._emit(item)
            return
        branch, jumps = self._add(BRANCH, []), []
        for way in ways:
            self.arg[branch].append(len(self.op))
            for item in way:
                self._emit(item)
            jumps.append(self._add(JUMP, None))
        for j in jumps:
            self.arg[j] = len(self.op)

    def _emit(self, item) -> None:
        if isinstance(item, list):
            self._emit_alternatives(item)
        elif isinstance(item, tuple):
            mark, inner = item
            if mark == "?":
                branch = self._add(BRANCH, [len(self.op) + 1])
                self._emit(inner)
                self.arg[branch].append(len(self.op))
            else:
                if mark == "+":
                    self._emit(inner)
                branch = self._add(BRANCH, [len(self.op) + 1])
                self._emit(inner)
                self._add(JUMP, branch)
                self.arg[branch].append(len(self.op))
        elif item[0] == "@":
            first = self.dialects.index(item[1:])
            self._add(GUARD, sum(1 << d for d in range(first, len(self.dialects))))
        elif item[0] == "'":
            self._add(MATCH, self.kinds.setdefault(item[1:-1].replace("\\'", "'"), len(self.kinds)))
        elif item.isupper():
            self._add(MATCH, self.kinds.setdefault(item, len(self.kinds)))
        else:
            self._add(CALL, item)

    def _lookahead(self) -> None:
        """First sets of all slots to a fixed point, then follow sets, then the table of each branch."""
        n = len(self.op)
        self.arg = [self.rule_of[a] if o == CALL else a for o, a in zip(self.op, self.arg)]
        first, empty = [set() for _ in range(n)], [False] * n
        follow = [set() for _ in self.start]

        def grow(add) -> None:
            changed = True
            while changed:
                changed = False
                for s in range(n - 1, -1, -1):
                    changed |= add(s)

        def first_of(s: int) -> bool:
            op, arg = self.op[s], self.arg[s]
            f, e = first[s], empty[s]
            if op == MATCH:
                new, ne = {arg}, False
            elif op == CALL:
                c = self.start[arg]
                new, ne = set(first[c]), False
                if empty[c]:
                    new |= first[s + 1]
                    ne = empty[s + 1]
            elif op == BRANCH:
                new, ne = set().union(*(first[t] for t in arg)), any(empty[t] for t in arg)
            elif op == JUMP:
                new, ne = first[arg], empty[arg]
            elif op == GUARD:
                new, ne = first[s + 1], empty[s + 1]
            else:
                new, ne = set(), True
            if new <= f and ne == e:
                return False
            f |= new
            empty[s] = ne
            return True

        def follow_of(s: int) -> bool:
            if self.op[s] != CALL:
                return False
            new = first[s + 1] | (follow[self.rule_at[s]] if empty[s + 1] else set())
            if new <= follow[self.arg[s]]:
                return False
            follow[self.arg[s]] |= new
            return True

        grow(first_of)
        for f in follow:
            f.add(0)  # any rule may be a start rule
        grow(follow_of)

        def table(targets: list[int], rule: int) -> dict[int, tuple[int, ...]]:
            out: dict[int, list[int]] = {}
            for t in targets:
                for k in first[t] | (follow[rule] if empty[t] else set()):
                    out.setdefault(k, []).append(t)
            return {k: tuple(v) for k, v in out.items()}

        self.arg = [table(a, self.rule_at[s]) if o == BRANCH else a for s, (o, a) in enumerate(zip(self.op, self.arg))]
        # a call is refused at once if the rule can't begin with the next token
        self.may = [first[c] | (follow[r] if empty[c] else set()) for r, c in enumerate(self.start)]

    def codes(self, kinds: list[str]) -> list[int]:
        get = self.kinds.get
        return [get(k, -1) for k in kinds] + [0]

    def accepts(self, kinds: list[str], start: str) -> tuple[str, ...]:
        """The dialects in which rule `start` derives the whole sequence of token kinds."""
        return self.parse(kinds, start)[0]

    def parse(self, kinds: list[str], start_rule: str) -> tuple[tuple[str, ...], int]:
        """The dialects, run together over one stack, in which `start_rule` derives the whole sequence of token kinds, and
        the number of tokens of the longest beginning that any of them could still go on from.

        All ways move on token by token together, so that only the calls made at the present token are looked up;
        older nodes live as long as a stack goes through them. Where one way is left it runs on without bookkeeping.
        """
        toks = self.codes(kinds)
        last = len(toks) - 1
        op, arg, start, may = self.op, self.arg, self.start, self.may
        called_here: dict[tuple[int, int], _Node] = {}  # by rule and dialects
        seen: set[tuple[int, _Node, int]] = set()  # ways that were set aside at this token
        every = (1 << len(self.dialects)) - 1
        root = called_here[self.rule_of[start_rule], every] = _Node([])
        now: list[tuple[int, _Node, int]] = [(start[self.rule_of[start_rule]], root, every)]
        following: list[tuple[int, _Node, int]] = []
        i, tok = 0, toks[0]
        while True:
            if now:
                slot, node, mask = now.pop()
            elif following:
                i += 1
                tok = toks[i]
                now = list(dict.fromkeys(following)) if len(following) > 1 else following
                following, called_here = [], {}
                seen.clear()
                slot, node, mask = now.pop()
            else:
                break
            while True:
                o = op[slot]
                if o == MATCH:
                    if tok != arg[slot]:
                        break
                    slot += 1
                    if now or following:
                        following.append((slot, node, mask))
                        break
                    i += 1
                    tok = toks[i]
                    called_here = {}
                    if seen:
                        seen.clear()
                elif o == CALL:
                    r = arg[slot]
                    if tok not in may[r]:
                        break
                    called = called_here.get((r, mask))
                    if called is None:
                        called_here[r, mask] = called = _Node([(slot + 1, node)])
                        slot, node = start[r], called
                        continue
                    edge = (slot + 1, node)
                    if edge in called.edges:
                        break
                    called.edges.append(edge)
                    if called.end != i:
                        break
                    slot += 1  # the rule has already derived nothing here
                    mask = called.ended
                elif o == BRANCH:
                    ways = arg[slot].get(tok)
                    if ways is None:
                        break
                    if len(ways) > 1:
                        for w in ways[1:]:
                            if (w, node, mask) not in seen:
                                seen.add((w, node, mask))
                                now.append((w, node, mask))
                    slot = ways[0]
                elif o == JUMP:
                    slot = arg[slot]
                elif o == GUARD:
                    mask &= arg[slot]
                    if not mask:
                        break
                    slot += 1
                else:
                    if node.end != i:
                        node.end, node.ended = i, mask
                    elif mask | node.ended == node.ended:
                        break
                    else:
                        node.ended |= mask
                    edges = node.edges
                    if not edges:
                        break
                    for s, n in edges[1:]:
                        if (s, n, mask) not in seen:
                            seen.add((s, n, mask))
                            now.append((s, n, mask))
                    slot, node = edges[0]
        ended = root.ended if root.end == last else 0
        return tuple(d for at, d in enumerate(self.dialects) if ended >> at & 1), i
