"""A small tree over the standard library's HTML tokenizer, for the page extractor."""

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    __slots__ = ("tag", "attrs", "classes", "inside", "found")

    def __init__(self, tag, attrs=()):
        self.tag, self.attrs, self.inside, self.found = tag, dict(attrs), [], None
        self.classes = self.attrs["class"].split() if self.attrs.get("class") else []

    def walk(self):
        """Elements below this one in document order, without recursion."""
        stack = list(reversed(self.inside))
        while stack:
            top = stack.pop()
            yield top
            if isinstance(top, Node):
                stack.extend(reversed(top.inside))

    def below(self, tag):
        """Elements with this tag; the tree below is walked once for all searches."""
        if self.found is None:
            self.found = {}
            for n in self.walk():
                if isinstance(n, Node):
                    self.found.setdefault(n.tag, []).append(n)
        return self.found.get(tag, ())

    def links_to_text(self, asked):
        """Put the address in the place of every anchor for which ``asked`` holds."""
        for parent in [self, *(n for n in self.walk() if isinstance(n, Node))]:
            parent.inside = [n.attrs["href"] if isinstance(n, Node) and n.tag == "a" and asked(n.attrs.get("href") or "") else n
                             for n in parent.inside]
            parent.found = None

    def all(self, tag, name=None):
        """Elements with this tag and, if given, this class; ``""`` asks for no class at all."""
        return [n for n in self.below(tag) if n.is_a(name)]

    def first(self, tag, name=None):
        return next((n for n in self.below(tag) if n.is_a(name)), None)

    def is_a(self, name):
        if name is None:
            return True
        if name == "":
            return not self.classes
        # several classes are asked for as the whole attribute
        return " ".join(self.classes) == name if " " in name else name in self.classes

    def text(self):
        if all(isinstance(n, str) for n in self.inside):
            return "".join(self.inside)
        return "".join(n for n in self.walk() if isinstance(n, str))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]

    def updatepos(self, i, j):
        # nobody asks for line numbers
        return j

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs)
        self.open[-1].inside.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].inside.append(Node(tag, attrs))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.open[0]
