"""RDF formats and query forms."""

import pytest

from orrery.operators import rdf

TURTLE = '@prefix e: <http://e/> . e:a a e:T ; e:n "x"@en , "y" ; e:k 5 ; e:to e:b , [ e:n "in" ] . e:b e:n "z" .'
XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/">
<e:T rdf:about="http://e/a"><e:n xml:lang="en">x</e:n><e:n>y</e:n><e:k rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</e:k>
<e:to rdf:resource="http://e/b"/><e:to><rdf:Description><e:n>in</e:n></rdf:Description></e:to></e:T><rdf:Description rdf:about="http://e/b" e:n="z"/></rdf:RDF>"""
JSON_LD = """{"@context": {"e": "http://e/", "n": "e:n", "to": {"@id": "e:to", "@type": "@id"}}, "@graph": [
{"@id": "e:a", "@type": "e:T", "n": [{"@value": "x", "@language": "en"}, "y"], "e:k": 5, "to": ["e:b", {"n": "in"}]}, {"@id": "e:b", "n": "z"}]}"""


def plain(rows):
    return sorted(tuple("_" if isinstance(x, str) and x.startswith("_:") else x or "" for x in r) for r in rows)


def test_formats_agree():
    want = plain(rdf.parse_any(TURTLE))
    assert len(want) == 8
    assert plain(rdf.parse_any(XML)) == want and plain(rdf.parse_any(JSON_LD)) == want
    assert rdf.parse_any(" ") == []
    for bad in ("<a", "{", "[1]", '{"@context": "http://far/"}'):
        with pytest.raises(ValueError):
            rdf.parse_any(bad)
    assert rdf.parse_rdf_xml('<rdf:Description xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" rdf:about="http://e/a"><e:p rdf:parseType="Resource"><e:q>1</e:q></e:p></rdf:Description>')[0][3] == "blank"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_forms(spark):
    t = spark.createDataFrame(rdf.parse_turtle(TURTLE), rdf.SCHEMA)
    p = "PREFIX e: <http://e/> "
    assert rows(rdf.sparql(t, p + "CONSTRUCT { ?o e:from ?s . ?s a e:Known } WHERE { ?s e:to ?o . ?o e:n ?n . FILTER(?n = \"z\") }")) == [("http://e/a", rdf.TYPE, "http://e/Known"), ("http://e/b", "http://e/from", "http://e/a")]
    assert rows(rdf.sparql(t, p + "DESCRIBE e:b")) == [("http://e/b", "http://e/n", "z")]
    assert rows(rdf.sparql(t, p + "DESCRIBE ?x WHERE { e:a e:to ?x . ?x e:n \"z\" }")) == [("http://e/b", "http://e/n", "z")]
    assert rows(rdf.sparql(t, p + "SELECT ?x WHERE { { ?x e:k 5 } UNION { ?x e:n \"z\" } }")) == [("http://e/a",), ("http://e/b",)]
    assert rows(rdf.sparql(t, p + "SELECT (COUNT(DISTINCT ?n) AS ?c) (SUM(?k) AS ?s) WHERE { ?x e:n ?n ; e:k ?k }")) == [(2, 10.0)]
    assert rdf.sparql(t, p + "SELECT ?n WHERE { ?x e:n ?n } ORDER BY DESC(?n) LIMIT 2 OFFSET 1").collect() == [("y",), ("x",)]
    assert rows(rdf.sparql(t, p + "SELECT ?x ?k WHERE { ?x e:n ?n OPTIONAL { ?x e:k ?k } FILTER regex(?n, \"^Z\", \"i\") }")) == [("http://e/b", None)]
    assert rdf.sparql(t, p + "ASK { e:b e:k ?k }").first()[0] is False
    for bad in ("SELECT ?x WHERE { ?x e:n }", "SELECT ?x WHERE { ?x e:n ?y . FILTER(?y + 1) }", "DELETE WHERE { ?s ?p ?o }"):
        with pytest.raises((ValueError, KeyError)):
            rdf.sparql(t, p + bad)


def test_patterns_join_on_shared_variables(spark):
    t = spark.createDataFrame([(f"s{i}", "p", f"m{i}", "iri", None, None) for i in range(5)] + [(f"m{i}", "q", f"e{i}", "iri", None, None) for i in range(5)], rdf.SCHEMA)
    out = rdf.bgp(t, [("?a", "p", "?b"), ("?c", "r", "?d"), ("?b", "q", "?c")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and out.count() == 0
