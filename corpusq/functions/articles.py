"""P20. Sections of an article's XML, by a streaming parser in Arrow batches: the JVM's functions take one flat schema, and
sections nest. (Type hints of a pandas UDF must be there at run time, so this module does not postpone them.)"""

from xml.parsers import expat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

SECTIONS = ArrayType(StructType([StructField(c, StringType()) for c in ("kind", "title", "text")]))


def sections_of(xml: str) -> list[dict[str, str]] | None:
    """The first abstract (kind abstract) and the sections that stand directly in the first body, in this order, each with all its
    text, that of sections within it too: comments are no text, CDATA and entities are. title: what its title has before any
    element within. None if the XML does not parse."""
    path: list[str] = []
    abstract: list[str] | None = None
    body_at, bodies = 0, 0  # how deep the first body is, and whether it has been
    abstract_at = 0
    found: list[dict] = []
    section_at = title_at = 0

    def start(name, attributes):
        nonlocal abstract, abstract_at, body_at, bodies, section_at, title_at
        path.append(name)
        depth = len(path)
        if title_at:
            found[-1]["title_open"] = False
        if name == "abstract" and abstract is None:
            abstract, abstract_at = [], depth
        if name == "body" and not bodies:
            bodies, body_at = 1, depth
        elif body_at and depth == body_at + 1 and name == "sec":
            section_at = depth
            found.append({"kind": attributes.get("sec-type", "").strip().lower(), "title": [], "parts": [], "title_open": False, "titled": False})
        elif section_at and depth == section_at + 1 and name == "title" and not found[-1]["titled"]:
            title_at = depth
            found[-1] |= {"title_open": True, "titled": True}

    def end(name):
        nonlocal abstract_at, body_at, section_at, title_at
        depth = len(path)
        abstract_at = 0 if depth == abstract_at else abstract_at
        body_at = 0 if depth == body_at else body_at
        section_at = 0 if depth == section_at else section_at
        title_at = 0 if depth == title_at else title_at
        path.pop()

    def text(data):
        if abstract_at:
            abstract.append(data)
        if section_at:
            found[-1]["parts"].append(data)
            if title_at and found[-1]["title_open"]:
                found[-1]["title"].append(data)

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    try:
        parser.Parse(xml, True)
    except (expat.ExpatError, ValueError):
        return None
    out = [] if abstract is None else [{"kind": "abstract", "title": "", "text": "".join(abstract)}]
    return out + [{"kind": s["kind"], "title": "".join(s["title"]), "text": "".join(s["parts"])} for s in found]


@F.pandas_udf(SECTIONS)
def article_parts(xml: pd.Series) -> pd.Series:
    """Of each article; no entries if it is null or does not parse."""
    return pd.Series([(sections_of(x) or []) if x is not None else [] for x in xml], dtype="object")
