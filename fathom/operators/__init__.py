"""Search operators as pairs of Columns: does a row match, and how well."""

from fathom.operators.compound import compound
from fathom.operators.embedded import embedded_document, has_ancestor, has_root
from fathom.operators.predicates import equals, exists, geo_shape, geo_within, in_, near, range_
from fathom.operators.query_string import query_string, text_range
from fathom.operators.span import span
from fathom.operators.text import autocomplete, by_pattern, more_like_this, phrase, search, term, text
from fathom.operators.vector import as_operator, knn_beta
from fathom.plans.compiler import everything
from fathom.plans.errors import only


def all_documents(c, scope, body):
    only(body, "", "allDocuments")
    return everything()


OPERATORS = {
    "allDocuments": all_documents,
    "autocomplete": autocomplete,
    "compound": compound,
    "embeddedDocument": embedded_document,
    "equals": equals,
    "exists": exists,
    "geoShape": geo_shape,
    "geoWithin": geo_within,
    "hasAncestor": has_ancestor,
    "hasRoot": has_root,
    "in": in_,
    "knnBeta": knn_beta,
    "moreLikeThis": more_like_this,
    "near": near,
    "phrase": phrase,
    "queryString": query_string,
    "range": range_,
    "regex": by_pattern("regex"),
    "search": search,
    "span": span,
    "term": term,
    "text": text,
    "vectorSearch": as_operator,
    "wildcard": by_pattern("wildcard"),
    "__range": text_range,
}
