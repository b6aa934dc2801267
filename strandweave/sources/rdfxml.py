"""RDF/XML documents as triples, by the W3C's syntax specification."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from urllib.parse import urljoin

# The vocabulary's own names.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_XML = "{http://www.w3.org/XML/1998/namespace}"
_SYNTAX = ("about", "ID", "nodeID", "resource", "datatype", "parseType", "bagID", "aboutEach", "aboutEachPrefix")


def _uri(tag: str) -> str:
    """``{namespace}local`` as one name."""
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class _Document:
    def __init__(self, scope: str):
        self.scope, self.made, self.triples = scope, 0, []

    def blank(self, name: str | None = None) -> str:
        if name is None:
            self.made += 1
            return f"_:{self.scope}g{self.made}"
        return f"_:{self.scope}n{name}"

    def link(self, s: str, p: str, o: str) -> None:
        self.triples.append((s, p, o, "blank" if o.startswith("_:") else "uri", None, None))

    def literal(self, s: str, p: str, text: str, lang: str | None, datatype: str | None = None) -> None:
        self.triples.append((s, p, text, "literal", None if datatype else lang or None, datatype))

    def attributes(self, s: str, element: ET.Element, base: str, lang: str | None) -> None:
        """Attributes that are properties."""
        for name, value in element.attrib.items():
            uri = _uri(name)
            if name.startswith(_XML) or not name.startswith("{") or uri in {RDF + x for x in _SYNTAX}:
                continue
            if uri == RDF + "type":
                self.link(s, uri, urljoin(base, value))
            else:
                self.literal(s, uri, value, lang)

    def node(self, element: ET.Element, base: str, lang: str | None) -> str:
        """An element that stands for a resource."""
        base, lang = urljoin(base, element.get(_XML + "base", "")), element.get(_XML + "lang", lang)
        get = lambda name: element.get(f"{{{RDF}}}{name}")
        if get("about") is not None:
            s = urljoin(base, get("about"))
        elif get("ID") is not None:
            s = f"{base.partition('#')[0]}#{get('ID')}"
        else:
            s = self.blank(get("nodeID"))
        if _uri(element.tag) != RDF + "Description":
            self.link(s, RDF + "type", _uri(element.tag))
        self.attributes(s, element, base, lang)
        self.properties(s, element, base, lang)
        return s

    def properties(self, s: str, element: ET.Element, base: str, lang: str | None) -> None:
        members = 0
        for child in element:
            p = _uri(child.tag)
            if p == RDF + "li":
                members += 1
                p = f"{RDF}_{members}"
            self.property(s, p, child, base, lang)

    def property(self, s: str, p: str, element: ET.Element, base: str, lang: str | None) -> None:
        base, lang = urljoin(base, element.get(_XML + "base", "")), element.get(_XML + "lang", lang)
        get = lambda name: element.get(f"{{{RDF}}}{name}")
        kind = get("parseType")
        own = [n for n in element.attrib if n.startswith("{") and not n.startswith(_XML) and _uri(n) not in {RDF + x for x in _SYNTAX}]
        if kind == "Resource":
            o = self.blank()
            self.link(s, p, o)
            self.properties(o, element, base, lang)
        elif kind == "Collection":
            at = (s, p)
            for child in element:
                cell = self.blank()
                self.link(*at, cell)
                self.link(cell, RDF + "first", self.node(child, base, lang))
                at = (cell, RDF + "rest")
            self.link(*at, RDF + "nil")
        elif kind is not None:
            inner = (element.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in element)
            self.literal(s, p, inner, None, RDF + "XMLLiteral")
        elif get("resource") is not None or get("nodeID") is not None or own:
            o = urljoin(base, get("resource")) if get("resource") is not None else self.blank(get("nodeID"))
            self.link(s, p, o)
            self.attributes(o, element, base, lang)
        elif len(element):
            self.link(s, p, self.node(element[0], base, lang))
        else:
            datatype = get("datatype")
            self.literal(s, p, element.text or "", lang, urljoin(base, datatype) if datatype else None)


def parse(text: str, scope: str = "b") -> tuple[list[tuple], dict[str, str]]:
    """Triples ``(s, p, o, kind, lang, datatype)`` and the prefixes of an RDF/XML text."""
    prefixes: dict[str, str] = {}
    root = None
    try:
        for event, found in ET.iterparse(io.BytesIO(text.encode()), events=("start-ns", "end")):
            if event == "start-ns":
                prefixes.setdefault(*found)
            else:
                root = found
    except ET.ParseError as e:
        raise ValueError(f"no RDF/XML text: {e}") from e
    document = _Document(scope)
    base, lang = root.get(_XML + "base", ""), root.get(_XML + "lang")
    for element in root if _uri(root.tag) == RDF + "RDF" else [root]:
        document.node(element, base, lang)
    return document.triples, {k: v for k, v in prefixes.items() if k}
