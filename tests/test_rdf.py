import pytest

from ontoflow.operators.bgp import match
from ontoflow.plans.schema import Schema, strongly_connected
from ontoflow.sources.rdf import OWL, TYPE, XSD, facts_from_triples, graph_triples, import_individuals, literal, literal_parts, malformed_ntriples, parse_rdfxml, parse_turtle, read_ntriples, triples_frame, turtle_text, write_ntriples

PREFIX = f"@prefix e: <urn:e:> . @prefix owl: <{OWL}> . @prefix xsd: <{XSD}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"


def test_turtle():
    t = parse_turtle(PREFIX + """
        e:a a e:C, e:D ; e:p "x\\n\\"y" , 'z'@en , "1"^^xsd:int , 2 , 2.5 , 1e3 , true .  # a comment
        e:a e:q [ e:r ( e:b "c" ) ] . _:n e:p e:a.b . [] e:p \"\"\"long "text" here\"\"\" .
    """)
    assert ("urn:e:a", TYPE, "urn:e:D") in t
    assert {o for s, p, o in t if p == "urn:e:p" and s == "urn:e:a"} == {literal('x\n"y'), '"z"@en', f'"1"^^<{XSD}int>', f'"2"^^<{XSD}integer>', f'"2.5"^^<{XSD}decimal>', f'"1e3"^^<{XSD}double>', f'"true"^^<{XSD}boolean>'}
    assert ("_:n", "urn:e:p", "urn:e:a.b") in t and any(o == '"long \\"text\\" here"' for _, _, o in t)
    assert literal_parts(literal('x\n"y', XSD + "string")) == ('x\n"y', XSD + "string")
    with pytest.raises(ValueError):
        parse_turtle("e:a e:b e:c .")


def test_rdfxml_equals_turtle():
    xml = f"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="{OWL}" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#">
    <owl:Class rdf:about="urn:e:A"><rdfs:subClassOf rdf:resource="urn:e:B"/><owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType="Collection">
    <rdf:Description rdf:about="urn:e:B"/><owl:Restriction><owl:onProperty rdf:resource="urn:e:p"/><owl:someValuesFrom rdf:resource="urn:e:C"/></owl:Restriction>
    </owl:intersectionOf></owl:Class></owl:equivalentClass><rdfs:label xml:lang="en">a</rdfs:label></owl:Class></rdf:RDF>"""
    ttl = PREFIX + """e:A a owl:Class ; rdfs:subClassOf e:B ; rdfs:label "a"@en ; owl:equivalentClass [ a owl:Class ; owl:intersectionOf ( e:B [ a owl:Restriction ; owl:onProperty e:p ; owl:someValuesFrom e:C ] ) ] ."""
    a, b = Schema.from_triples(parse_rdfxml(xml)), Schema.from_triples(parse_turtle(ttl))
    assert (a.sub, a.equivalent, a.classes) == (b.sub, b.equivalent, b.classes)
    assert [str(x) for x, _ in a.rules()] == [str(x) for x, _ in b.rules()]


def test_ntriples_round_trip(spark, tmp_path):
    t = triples_frame(spark, parse_turtle(PREFIX + 'e:a a e:C ; e:p e:b , "x y . z"@en , "7"^^xsd:integer . _:k e:p e:a .'))
    write_ntriples(t, str(tmp_path / "t"))
    assert sorted(map(tuple, read_ntriples(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, t.collect()))
    facts = facts_from_triples(t)
    assert {(r.id, r.num) for r in facts.graph.nodes.where("dt LIKE '%integer'").collect()} == {(f'"7"^^<{XSD}integer>', 7.0)}
    assert facts_from_triples(t, literals=False).graph.edges.count() == 2
    again = graph_triples(facts.graph)
    assert again.where("p = 'urn:e:p'").count() == 4
    assert [r.x for r in match(t, [("?x", TYPE, "urn:e:C"), ("?x", "urn:e:p", "urn:e:b")], ["x"]).collect()] == ["urn:e:a"]
    with pytest.raises(ValueError):
        match(t, [("?x", TYPE, "?y"), ("?z", TYPE, "?w")])


def test_ntriples_by_the_grammar(spark, tmp_path):
    """Terms equal those of the Turtle parser, whatever is escaped; lines without spaces count, others are told."""
    lines = [r'<urn:e:a><urn:e:p><urn:e:b>.', r'<urn:e:a> <urn:e:p> "caf\u00e9 \U0001F600 \"q\" \\ tab\t \n"@en .', r"_:n1	<urn:e:p>	_:n2 . # said", "", "# only a comment", r'<urn:e:\u00fc> <urn:e:p> "1"^^<' + XSD + 'integer>.', r'<urn:e:c> <urn:e:p> "it\'s \u0022" .']
    (tmp_path / "a.nt").write_text("\n".join(lines), encoding="utf-8")
    got = {tuple(r) for r in read_ntriples(spark, str(tmp_path / "a.nt")).collect()}
    turtle = PREFIX + """e:a e:p e:b , "caf\\u00e9 \\U0001F600 \\"q\\" \\\\ tab\\t \\n"@en . _:n1 e:p _:n2 . <urn:e:ü> e:p 1 . e:c e:p "it's \\"" ."""
    assert {t for t in got if not t[0].startswith("_:")} == {t for t in parse_turtle(turtle) if not t[0].startswith("_:")} and ("_:n1", "urn:e:p", "_:n2") in got
    (tmp_path / "b.nt").write_text('<urn:e:a> <urn:e:p> <urn:e:b>\n<urn:e:a> <urn:e:p> "x .\n<urn:e:a> <urn:e:p> <urn:e:c> .\n' + '<urn:e:a> <urn:e:p> "' + "y\\n" * 50_000 + '" .\n')
    assert read_ntriples(spark, str(tmp_path / "b.nt"), malformed="skip").count() == 2 == malformed_ntriples(spark, str(tmp_path / "b.nt")).count()
    with pytest.raises(Exception, match="not a triple"):
        read_ntriples(spark, str(tmp_path / "b.nt")).collect()
    got.add(("urn:e:a b", "urn:e:p", "urn:e:{c}\\"))
    write_ntriples(triples_frame(spark, sorted(got)), str(tmp_path / "c"))
    assert {tuple(r) for r in read_ntriples(spark, str(tmp_path / "c")).collect()} == got


def test_turtle_round_trip():
    t = parse_turtle(PREFIX + 'e:a a e:C ; e:p e:b , "x\\n\\"y"@en , 7 , "1"^^e:unit . e:b e:q "plain" , e:a.b .')
    text = turtle_text(t, {"e": "urn:e:", "xsd": XSD})
    assert "e:a a e:C" in text and "^^xsd:integer" in text and sorted(parse_turtle(text)) == sorted(t)


def test_individuals_of_the_schema(spark):
    schema = parse_turtle(PREFIX + """e:port a owl:NamedIndividual , e:Harbour ; e:in e:bay . e:bay a owl:NamedIndividual , e:Water . e:haven a owl:NamedIndividual ; owl:sameAs e:port ; e:depth 9 .
        e:inland a owl:NamedIndividual , e:Town .""")
    data = triples_frame(spark, [("urn:e:ship", "urn:e:calls", "urn:e:port")])
    got = {tuple(r) for r in import_individuals(data, schema).collect()}
    assert {("urn:e:port", "urn:e:depth", f'"9"^^<{XSD}integer>'), ("urn:e:bay", TYPE, "urn:e:Water"), ("urn:e:ship", "urn:e:calls", "urn:e:port")} <= got
    assert not any("inland" in x for t in got for x in t) and import_individuals(data, []).count() == 1


def test_components_order():
    assert strongly_connected({"a": {"b"}, "b": {"c"}, "c": {"b"}, "d": set()}) == [["b", "c"], ["a"], ["d"]]
