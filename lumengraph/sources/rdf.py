"""RDF text as quads, read line by line in parallel; quads as text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengraph.functions.columns import is_iri, skolem
from lumengraph.model import RDF_LANG_STRING, RDF_TYPE, XSD

#: A statement: subject, predicate, object as IRI, blank node or literal with datatype or language, and maybe a graph.
STATEMENT = r'^\s*(?:<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|_:(\S+?)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*(?:<([^>]*)>)?\s*\.\s*(?:#.*)?$'


#: What the escapes of one letter stand for.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescaped(text: Column) -> Column:
    """A literal's text with its escapes undone, those of code points (four or eight hexadecimal digits) too."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)|[^\\]+"), F.lit(0))

    def one(part: Column) -> Column:
        letter = F.substring(part, 2, 1)
        code = F.decode(F.unhex(F.lpad(F.substring(part, 3, 8), 8, "0")), "UTF-32")
        known = F.create_map(*(F.lit(x) for pair in ESCAPES.items() for x in pair))
        return F.when(~F.startswith(part, F.lit("\\")), part).when((F.length(part) > 2) & letter.isin("u", "U"), code).otherwise(F.coalesce(known[letter], part))

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def statements(lines: DataFrame, base: str = "http://example.org/", line_col: str = "value", document: Column | None = None, strict: bool = True) -> DataFrame:
    """Quads of N-Triples or N-Quads lines. Blank nodes become IRIs, the same within a document; empty lines and comments
    give nothing. If strict, a line that is no statement, or holds an IRI of a scheme that isn't allowed, fails the job;
    else such lines are left out here, and ``rejected`` has them."""
    rows = _read(lines, base, line_col, document)
    if strict:
        bad = F.raise_error(F.concat(F.lit("not a statement: "), F.col("line")))
        rows = rows.withColumn("subject", F.when(F.col("fine") | F.col("empty"), F.col("subject")).otherwise(bad))
    else:
        rows = rows.where("fine")
    return rows.select("subject", "predicate", "object", "datatype", "language", "graph")


def rejected(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(line): the lines that ``statements`` can't read."""
    return _read(lines, "http://example.org/", line_col, None).where("not fine").select("line")


def _read(lines: DataFrame, base: str, line_col: str, document: Column | None) -> DataFrame:
    """The parts of each line that is neither empty nor a comment, and whether it is a fine statement."""
    part = lambda i: F.regexp_extract(line_col, STATEMENT, i)
    own = document if document is not None else F.lit("")
    empty = F.coalesce(F.col(line_col).rlike(r"^\s*(?:#.*)?$"), F.lit(True))
    kept = lines.where(~empty)
    subject = F.when(part(1) != "", part(1)).otherwise(skolem(own, part(2), base))
    literal = F.col(line_col).rlike(r'^\s*\S+\s+<[^>]*>\s+"')
    datatype = F.when(~literal, "").when(part(8) != "", F.lit(RDF_LANG_STRING)).when(part(7) != "", part(7)).otherwise(F.lit(XSD + "string"))
    value = F.when(literal, unescaped(part(6))).when(part(4) != "", part(4)).otherwise(skolem(own, part(5), base))
    rows = kept.select(subject.alias("subject"), part(3).alias("predicate"), value.alias("object"), datatype.alias("datatype"), part(8).alias("language"), part(9).alias("graph"), F.col(line_col).rlike(STATEMENT).alias("fine"), F.col(line_col).alias("line"), empty.alias("empty"))
    fine = F.col("fine") & is_iri(F.col("subject")) & is_iri(F.col("predicate")) & ((F.col("datatype") != "") | is_iri(F.col("object")))
    return rows.withColumn("fine", F.coalesce(fine, F.lit(False)))


def read_ntriples(spark: SparkSession, path: str, **options) -> DataFrame:
    return statements(spark.read.text(path).withColumn("file", F.input_file_name()), document=F.col("file"), **options)


def json_documents(rows: DataFrame, predicates: dict[str, str], base: str, types: dict[str, str], json_col: str = "json") -> DataFrame:
    """Quads of JSON-LD objects ``{"@id", "@type", key: value}``, by the IRIs of their keys and types.

    Keys are those of predicates, types one or several. A value is a string, a number or a boolean, which become literals of
    that kind; ``{"@id"}``, a link; ``{"@value"}`` with ``@type`` or ``@language``, a literal of these; an object nested in the
    document, which becomes a link to a subject of its own with the same keys and types, one level deep; or a list of these.
    An object without an id gets one from its content. Rows that are no objects give nothing.
    """
    doc = F.try_parse_json(json_col)
    top = rows.select(doc.alias("d")).where(F.startswith(F.schema_of_variant("d"), F.lit("OBJECT")))
    own = _values(top.select(_id(F.col("d"), base).alias("subject"), "d"), predicates)
    inner = own.where(_nested(F.col("v"))).select(_id(F.col("v"), base).alias("subject"), F.col("v").alias("d"))
    below = _values(inner, predicates)
    documents = top.select(_id(F.col("d"), base).alias("subject"), "d").unionByName(inner)
    kinds = documents.select("subject", F.explode(_listed(_at(F.col("d"), "@type"))).alias("v")).select("subject", F.variant_get("v", "$", "string").alias("name"))
    named = F.create_map(*(F.lit(x) for pair in types.items() for x in pair)) if types else None
    typed = kinds.where("name is not null").select("subject", F.lit(RDF_TYPE).alias("predicate"), (F.coalesce(named[F.col("name")], F.col("name")) if types else F.col("name")).alias("object"), F.lit("").alias("datatype"), F.lit("").alias("language"))
    v, given = F.col("v"), F.coalesce(_at(F.col("v"), "@value"), F.col("v"))
    link = F.coalesce(_text(v, "@id"), F.when(_nested(v), _id(v, base)))
    language = F.when(link.isNull(), _text(v, "@language"))
    kind = F.schema_of_variant(given)
    read = F.when(kind == "BIGINT", XSD + "integer").when(F.startswith(kind, F.lit("DECIMAL")) | (kind == "DOUBLE"), XSD + "double").when(kind == "BOOLEAN", XSD + "boolean").otherwise(XSD + "string")
    datatype = F.when(link.isNotNull(), "").when(language.isNotNull(), RDF_LANG_STRING).otherwise(F.coalesce(_text(v, "@type"), read))
    held = own.unionByName(below).select("subject", "predicate", F.coalesce(link, F.variant_get(given, "$", "string")).alias("object"), datatype.alias("datatype"), F.coalesce(language, F.lit("")).alias("language"))
    return typed.unionByName(held).where("object is not null").select("*", F.lit("").alias("graph"))


def _at(v: Column, key: str) -> Column:
    return F.variant_get(v, f"$['{key}']", "variant")


def _text(v: Column, key: str) -> Column:
    return F.variant_get(v, f"$['{key}']", "string")


def _id(v: Column, base: str) -> Column:
    return F.coalesce(_text(v, "@id"), F.concat(F.lit(f"{base}#"), F.sha2(F.to_json(v), 256)))


def _nested(v: Column) -> Column:
    """Whether a value is an object with properties of its own."""
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & _at(v, "@value").isNull() & (_text(v, "@id").isNull() | _at(v, "@type").isNotNull())


def _listed(v: Column) -> Column:
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), v.cast("array<variant>")).when(v.isNotNull() & ~F.is_variant_null(v), F.array(v))


def _values(documents: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """(subject, predicate, v): the values of the documents' keys, lists taken apart."""
    cells = [F.struct(F.lit(iri).alias("predicate"), _listed(_at(F.col("d"), key)).alias("vs")) for key, iri in predicates.items()]
    each = documents.select("subject", F.explode(F.array(*cells)).alias("c"))
    return each.select("subject", "c.predicate", F.explode("c.vs").alias("v")).where(~F.is_variant_null("v"))


def to_ntriples(quads: DataFrame) -> DataFrame:
    """A line (value) for each quad; the graph is written where there is one."""
    text = F.col("object")
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')):
        text = F.replace(text, F.lit(a), F.lit(b))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(F.col("language") != "", F.concat(F.lit("@"), F.col("language"))).when(F.col("datatype").isin("", XSD + "string"), "").otherwise(F.concat(F.lit("^^<"), F.col("datatype"), F.lit(">"))))
    graph = F.when(F.col("graph") != "", F.concat(F.lit(" <"), F.col("graph"), F.lit(">"))).otherwise("")
    return quads.select(F.concat(F.lit("<"), F.col("subject"), F.lit("> <"), F.col("predicate"), F.lit("> "), F.when(F.col("datatype") == "", F.concat(F.lit("<"), F.col("object"), F.lit(">"))).otherwise(literal), graph, F.lit(" .")).alias("value"))


def raw(datatype: Column, value: Column, language: Column) -> Column:
    """A value as JSON-LD has it: ``{"@id"}`` for a link, else ``{"@value", "@type"}`` with the language if there is one."""
    literal = F.to_json(F.struct(value.alias("@value"), datatype.alias("@type"), F.nullif(language, F.lit("")).alias("@language")))
    return F.when(datatype == "", F.to_json(F.struct(value.alias("@id")))).otherwise(literal)
