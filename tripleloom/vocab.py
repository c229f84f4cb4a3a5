"""Names of the mapping vocabularies, and how older ones read in the current one."""

from __future__ import annotations

from .rdf import RDF, XSD

RML = "http://w3id.org/rml/"
RR = "http://www.w3.org/ns/r2rml#"
OLD = "http://semweb.mmlab.be/ns/rml#"
QL = "http://semweb.mmlab.be/ns/ql#"
FNML = "http://semweb.mmlab.be/ns/fnml#"
FNO = "https://w3id.org/function/ontology#"
SD = "https://w3id.org/okn/o/sd#"
HTV = "http://www.w3.org/2011/http#"
RDF_TYPE = RDF + "type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
GREL = "http://users.ugent.be/~bjdmeest/function/grel.ttl#"
IDLAB = "https://w3id.org/imec/idlab/function#"
IDLAB_OLD = "http://example.com/idlab/function/"
#: The name space of engine functions, under whatever address: what follows this in a function's or parameter's IRI.
BUILT_IN = "/function/built-in.ttl#"

PREDICATES = (
    {RR + n: RML + n for n in "tableName parentTriplesMap subjectMap predicateObjectMap predicateMap objectMap graphMap subject predicate object graph template constant class child parent joinCondition datatype language sqlVersion termType".split()}
    | {RR + "logicalTable": RML + "logicalSource", RML + "logicalTable": RML + "logicalSource", RR + "sqlQuery": RML + "query", RML + "sqlQuery": RML + "query", RR + "column": RML + "reference", RML + "column": RML + "reference"}
    | {OLD + n: RML + n for n in "logicalSource source query iterator reference referenceFormulation quotedTriplesMap subjectMap objectMap languageMap datatypeMap".split()}
    | {FNML + n: RML + n for n in "input functionMap returnMap parameterMap function return parameter".split()}
    | {FNML + "execution": RML + "functionExecution", FNML + "valueMap": RML + "inputValueMap", FNML + "value": RML + "inputValue"}
)
OBJECTS = (
    {RR + n: RML + n for n in "defaultGraph IRI Literal BlankNode TriplesMap".split()}
    | {RR + "URI": RML + "IRI", RML + "URI": RML + "IRI", RML + "AssertedTriplesMap": RML + "TriplesMap", OLD + "NonAssertedTriplesMap": RML + "NonAssertedTriplesMap", OLD + "AssertedTriplesMap": RML + "TriplesMap", OLD + "RDFstarTriple": RML + "RDFstarTriple"}
    | {QL + n: RML + n for n in "CSV JSONPath XPath".split()}
)
SHORTCUTS = {RML + a: RML + b for a, b in {"subject": "subjectMap", "predicate": "predicateMap", "object": "objectMap", "graph": "graphMap", "language": "languageMap", "datatype": "datatypeMap", "function": "functionMap", "return": "returnMap", "parameter": "parameterMap", "inputValue": "inputValueMap"}.items()}
DEFAULT_GRAPH = RML + "defaultGraph"

PREFIXES = {
    "rml": RML, "fno": FNO, "xsd": XSD, "rdfs": RDFS, "rdf": RDF, "rr": RR, "grel": GREL, "idlab-fn": IDLAB,
    "owl": "http://www.w3.org/2002/07/owl#", "skos": "http://www.w3.org/2004/02/skos/core#", "skosxl": "http://www.w3.org/2008/05/skos-xl#", "foaf": "http://xmlns.com/foaf/0.1/",
    "schema": "http://schema.org/", "dc": "http://purl.org/dc/terms/", "dcterms": "http://purl.org/dc/terms/", "dc11": "http://purl.org/dc/elements/1.1/", "dcat": "http://www.w3.org/ns/dcat#",
    "prov": "http://www.w3.org/ns/prov#", "qb": "http://purl.org/linked-data/cube#", "void": "http://rdfs.org/ns/void#", "time": "http://www.w3.org/2006/time#", "org": "http://www.w3.org/ns/org#",
    "as": "https://www.w3.org/ns/activitystreams#", "csvw": "http://www.w3.org/ns/csvw#", "dqv": "http://www.w3.org/ns/dqv#", "duv": "https://www.w3.org/ns/duv#", "grddl": "http://www.w3.org/2003/g/data-view#",
    "jsonld": "http://www.w3.org/ns/json-ld#", "ldp": "http://www.w3.org/ns/ldp#", "ma": "http://www.w3.org/ns/ma-ont#", "oa": "http://www.w3.org/ns/oa#", "odrl": "http://www.w3.org/ns/odrl/2/",
    "rdfa": "http://www.w3.org/ns/rdfa#", "rif": "http://www.w3.org/2007/rif#", "sd": "http://www.w3.org/ns/sparql-service-description#", "ssn": "http://www.w3.org/ns/ssn/", "sosa": "http://www.w3.org/ns/sosa/",
    "wdr": "http://www.w3.org/2007/05/powder#", "wdrs": "http://www.w3.org/2007/05/powder-s#", "xhv": "http://www.w3.org/1999/xhtml/vocab#", "xml": "http://www.w3.org/XML/1998/namespace",
    "cc": "http://creativecommons.org/ns#", "ctag": "http://commontag.org/ns#", "gr": "http://purl.org/goodrelations/v1#", "ical": "http://www.w3.org/2002/12/cal/icaltzd#", "og": "http://ogp.me/ns#",
    "rev": "http://purl.org/stuff/rev#", "sioc": "http://rdfs.org/sioc/ns#", "v": "http://rdf.data-vocabulary.org/#", "vcard": "http://www.w3.org/2006/vcard/ns#",
}
