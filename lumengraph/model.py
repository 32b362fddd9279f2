"""The data model: a log of signed quads, and the vocabulary it uses."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names of the RDF and XML Schema vocabularies.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_RESOURCE = "http://www.w3.org/2000/01/rdf-schema#Resource"
RDF_LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
XSD = "http://www.w3.org/2001/XMLSchema#"

INSERT, DELETE = 1, -1

#: What makes two rows of the log speak of the same quad.
QUAD = ("subject", "predicate", "object", "datatype", "language", "graph")
#: What makes two rows of the log the same record.
RECORD = (*QUAD, "change_id", "sign")

LOG = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in QUAD]
    + [T.StructField("timestamp", T.TimestampType()), T.StructField("change_id", T.StringType(), False), T.StructField("sign", T.ByteType(), False)]
)

#: The Spark type that literals of a datatype are read as; an IRI (empty datatype) and any other stay strings.
READ_AS = {
    XSD + "boolean": "boolean",
    XSD + "int": "bigint",
    XSD + "integer": "bigint",
    XSD + "long": "bigint",
    XSD + "double": "double",
    XSD + "decimal": "double",
    XSD + "float": "double",
    XSD + "dateTime": "timestamp",
    XSD + "date": "date",
}
