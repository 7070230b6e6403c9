"""XMP sidecars as rows: a bounded parse that refuses what could harm, and says why."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bounds of what is parsed.
MOST_BYTES, MOST_NODES, MOST_ATTRIBUTES, MOST_DEPTH = 8 << 20, 20_000, 20_000, 64

# The namespaces of XMP; the codes of a refusal are fixed as well.
RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
LANG = "{http://www.w3.org/XML/1998/namespace}lang"
META = "{adobe:ns:meta/}xmpmeta"

SCHEMA = "path string, state string, code string, properties map<string,string>"


def _words(element: ElementTree.Element) -> str | None:
    """A property's text; a list's items by line; a choice of languages as lang=text by line."""
    if not len(element):
        return element.text or ""
    box = element[0]
    if len(element) != 1 or box.tag not in (RDF + "Bag", RDF + "Seq", RDF + "Alt"):
        return None
    items = [x for x in box if x.tag == RDF + "li" and not len(x)]
    if len(items) != len(box):
        return None
    return "\n".join(f"{x.get(LANG)}={x.text or ''}" if box.tag == RDF + "Alt" else x.text or "" for x in items)


class Refused(ValueError):
    """What the parser met that it does not read; the message is the code."""


class _Builder(ElementTree.TreeBuilder):
    """Counts while it builds, so that a document beyond the bounds is given up and never held whole."""

    def __init__(self) -> None:
        super().__init__()
        self.nodes = self.attributes = self.depth = 0

    def open(self, name: str, attributes: dict[str, str]) -> None:
        self.nodes += 1
        self.attributes += len(attributes)
        self.depth += 1
        if self.nodes > MOST_NODES or self.attributes > MOST_ATTRIBUTES or self.depth > MOST_DEPTH:
            raise Refused("xml_limit")
        full = lambda n: "{" + n if "}" in n else n
        self.start(full(name), {full(k): v for k, v in attributes.items()})

    def shut(self, name: str) -> None:
        self.depth -= 1
        self.end("{" + name if "}" in name else name)


def _refuse(*_: object) -> None:
    raise Refused("unsafe_xml")


def tree(data: bytes) -> ElementTree.Element:
    """The document, in whatever encoding it declares; a document type or an entity ends the reading where it starts."""
    builder, parser = _Builder(), expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = builder.open, builder.shut, builder.data
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = parser.ExternalEntityRefHandler = _refuse
    parser.Parse(data, True)
    return builder.close()


def parse(data: bytes) -> tuple[str, str | None, dict[str, str]]:
    """(state, code, properties): valid, needs_attention with a code, or not_xmp."""
    if len(data) > MOST_BYTES:
        return "needs_attention", "too_large", {}
    try:
        root = tree(data)
    except Refused as why:
        return "needs_attention", str(why), {}
    except (expat.ExpatError, ValueError):
        plain = data.replace(b"\0", b"")
        return ("needs_attention", "malformed", {}) if b"xmpmeta" in plain or b"rdf:RDF" in plain else ("not_xmp", None, {})
    rdf = root if root.tag == RDF + "RDF" else root.find(RDF + "RDF") if root.tag == META else None
    if rdf is None:
        return "not_xmp", None, {}
    found: dict[str, str] = {}
    for about in rdf.findall(RDF + "Description"):
        pairs = [(k, v) for k, v in about.attrib.items() if not k.startswith(RDF)] + [(x.tag, _words(x)) for x in about]
        for name, value in pairs:
            if value is None:
                return "needs_attention", "unsupported_property", {}
            if found.setdefault(name, value) != value:
                return "needs_attention", "conflicting_property", {}
    return "valid", None, found


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse(x or b"") for x in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([list(r[2].items()) for r in rows], pa.map_(pa.string(), pa.string()))], names=["path", "state", "code", "properties"]
        )


def read_sidecars(files: DataFrame) -> DataFrame:
    """files: path, content. One row a file."""
    return files.select("path", "content").mapInArrow(_parse, SCHEMA)
