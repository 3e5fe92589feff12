"""XML documents, each parsed once, whatever its namespaces and prefixes are.

A reader gets the root element, all names without namespaces, and picks what it needs; its strings are raw and are cleaned by
Spark afterwards. CDATA sections are text, comments are left out.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from citestat.functions.text import clean_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Reader = Callable[[Element], Any]

# text of the documents that are parsed and held at once
SLICE_BYTES = 1 << 20


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def well_formed(xml: Column | str) -> Column:
    parsed_once = F.from_xml(
        _col(xml), "_corrupt_record string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    return _col(xml).isNotNull() & parsed_once["_corrupt_record"].isNull()


def parsed(xml: Column | str, reader: Reader, kind: str, broken: Any = None) -> Column:
    """What ``reader`` returns for the root of each document, of SQL type ``kind``.

    NULL for NULL, and ``broken`` for what is not well-formed.
    """
    arrow = to_arrow_type(_parse_datatype_string(kind))

    def one(document: str | None) -> Any:
        if document is None:
            return None
        try:
            root = ElementTree.fromstring(document)
        except ElementTree.ParseError:
            return broken
        # names lose their namespaces once, so that elements are found by name without Python code for each
        for e in root.iter():
            e.tag = local(e)
        return reader(root)

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for documents in batches:
            # a share of the documents at a time bounds what their strings and results need, whatever the size of a batch
            size = max(1, int(len(documents) * SLICE_BYTES / max(documents.nbytes, SLICE_BYTES)))
            for at in range(0, len(documents), size):
                yield pa.array([one(d) for d in documents.slice(at, size).to_pylist()], arrow)

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(read, kind)(_col(xml))


def local(e: Element) -> str:
    """Name without its namespace."""
    return e.tag.rpartition("}")[2]


def children(e: Element, name: str) -> list[Element]:
    return e.findall(name)


def inside(e: Element, name: str) -> Iterator[Element]:
    """All elements of a name below ``e``, in document order."""
    return (c for c in e.iter(name) if c is not e)


def outermost(e: Element, name: str, **attributes: str) -> list[Element]:
    """Elements of a name (and attribute values) below ``e`` that are in no other one."""
    out, todo = [], list(reversed(e))
    while todo:
        c = todo.pop()
        if c.tag == name and all(c.get(k.replace("_", "-")) == v for k, v in attributes.items()):
            out.append(c)
        else:
            todo += reversed(c)
    return out


def text(e: Element | None) -> str | None:
    """All text in an element, nested markup included."""
    return None if e is None else "".join(e.itertext())


def first(elements: Iterator[Element] | list[Element]) -> Element | None:
    return next(iter(elements), None)


def filled(elements: Iterator[Element]) -> Iterator[Element]:
    return (e for e in elements if text(e).strip())


def texts(xml: Column | str, name: str) -> Column:
    """Cleaned texts of all elements of a name (the outermost ones), empty ones dropped."""
    found = parsed(xml, lambda root: [text(e) for e in outermost(root, name)], "array<string>", broken=[])
    return cleaned_texts(found)


def cleaned_texts(found: Column) -> Column:
    return F.filter(F.transform(found, clean_text), lambda t: t.isNotNull())
