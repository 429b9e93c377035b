"""Names and types of the data model, and the rule tables.

A *row* is one piece of evidence of one mapping: a subject-predicate-object triple
and where it comes from.  All operators take and return frames of rows; a mapping
is the set of rows of one triple (``operators.assemble.mappings`` sums them up).
Keeping evidence normalised lets a triple have any number of rows without one task
ever holding them as a list.
"""

from __future__ import annotations

SUBJECT, OBJECT = ["s_prefix", "s_id"], ["o_prefix", "o_id"]
TRIPLE = [*SUBJECT, "p", *OBJECT]
#: What tells one evidence of a triple from another; the mapping set does not.
IDENTITY = ["ev_type", "justification", "author", "row_confidence", "derived_from"]
PAYLOAD = ["confidence", "ms_id", "explanation"]
ROW = [*TRIPLE, *IDENTITY, *PAYLOAD]
ROW_SCHEMA = (
    "s_prefix string, s_id string, p string, o_prefix string, o_id string, ev_type string, justification string, author string, "
    "row_confidence double, derived_from array<string>, confidence double, ms_id string, explanation string"
)
MAPPING_SETS_SCHEMA = "ms_id string, title string, license string, version string, confidence double, source string"

EXACT, BROAD, NARROW, CLOSE = "skos:exactMatch", "skos:broadMatch", "skos:narrowMatch", "skos:closeMatch"
DB_XREF, SUBCLASS, SUBPROPERTY = "oboinowl:hasDbXref", "rdfs:subClassOf", "rdfs:subPropertyOf"
EQUIVALENT_CLASS, EQUIVALENT_PROPERTY, SAME_AS, REPLACED_BY = "owl:equivalentClass", "owl:equivalentProperty", "owl:sameAs", "iao:0100001"

MANUAL, LEXICAL, UNSPECIFIED = "semapv:ManualMappingCuration", "semapv:LexicalMatching", "semapv:UnspecifiedMatching"
INVERSION, CHAIN, KNOWLEDGE = "semapv:MappingInversion", "semapv:MappingChaining", "semapv:BackgroundKnowledgeBasedMatching"

# Predicates by rule.
IMPRECISE = (DB_XREF, CLOSE)
FLIP = {EXACT: EXACT, CLOSE: CLOSE, BROAD: NARROW, NARROW: BROAD}
GENERALIZATIONS = {EQUIVALENT_CLASS: EXACT, EQUIVALENT_PROPERTY: EXACT, SAME_AS: EXACT, SUBCLASS: BROAD, SUBPROPERTY: BROAD}
RELATIONS = (EXACT, BROAD, NARROW, CLOSE, SUBCLASS, SUBPROPERTY, DB_XREF, EQUIVALENT_CLASS, EQUIVALENT_PROPERTY, SAME_AS, REPLACED_BY)

CC0 = "https://creativecommons.org/publicdomain/zero/1.0/"
#: Confidences are rounded to so many places in all outputs.
PRECISION = 5
