import pytest

from ontoflow.operators import modes
from ontoflow.operators.explain import explain
from ontoflow.operators.closure import NotConverged
from ontoflow.operators.negative import Conflict
from ontoflow.plans.compile import Compiler
from ontoflow.plans.ir import Dag
from ontoflow.plans.schema import Schema
from ontoflow.sources.rdf import OWL, XSD, facts_from_triples, parse_turtle, triples_frame

PREFIX = f"@prefix e: <urn:e:> . @prefix owl: <{OWL}> . @prefix xsd: <{XSD}> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .\n"


def prepared(spark, schema, data, profile="full"):
    s, d = parse_turtle(PREFIX + schema), parse_turtle(PREFIX + data, "d")
    return modes.prepare(facts_from_triples(triples_frame(spark, s + d)), Schema.from_triples(s + d), modes.PROFILES[profile])


def members(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cls[6:], set()).add(r.id[6:])
    return out


def some(p, c):
    return f"[ a owl:Restriction ; owl:onProperty {p} ; owl:someValuesFrom {c} ]"


def test_necessary_conditions(spark):
    p = prepared(spark, f"""
        e:Linked a owl:Class ; rdfs:subClassOf e:Person , {some('e:knows', 'e:Person')} .
        e:Closed a owl:Class ; rdfs:subClassOf e:Person , [ a owl:Restriction ; owl:onProperty e:knows ; owl:allValuesFrom e:Person ] .
        e:Two a owl:Class ; rdfs:subClassOf e:Person , [ a owl:Restriction ; owl:onProperty e:knows ; owl:qualifiedCardinality 2 ; owl:onClass e:Person ] .
        e:Known a owl:Class ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty [ owl:inverseOf e:knows ] ; owl:someValuesFrom e:Person ] .
        e:Human a owl:Class ; rdfs:subClassOf e:Person ; owl:disjointWith e:Robot .""",
        "e:a a e:Person ; e:knows e:b , e:c . e:b a e:Person . e:c a e:Person , e:Robot ; e:knows e:box .")
    names = ["Linked", "Closed", "Two", "Known", "Human"]
    got = members(modes.admissibility(p, [f"urn:e:{n}" for n in names]))
    assert got == {"Linked": {"a"}, "Closed": {"a", "b"}, "Two": {"a"}, "Known": {"b", "c", "box"}, "Human": {"a", "b"}}


def test_role_box(spark):
    schema = """e:ally rdfs:subPropertyOf e:knows . e:knownBy owl:inverseOf e:knows . e:knows a owl:TransitiveProperty ; owl:propertyChainAxiom ( e:relay e:ally ) .
        e:Role a owl:Class ; rdfs:subClassOf e:Person , """ + some("e:knows", "e:Target") + " ."
    data = """e:t a e:Target . e:a a e:Person ; e:ally e:t . e:b a e:Person . e:t e:knownBy e:b . e:c a e:Person ; e:relay e:m . e:m e:ally e:t . e:d a e:Person ; e:knows e:a . e:x a e:Person ; e:relay e:t ."""
    for profile in ("full", "roles"):
        assert members(modes.admissibility(prepared(spark, schema, data, profile), ["urn:e:Role"])) == {"Role": {"a", "b", "c", "d"}}, profile


def test_fixpoints(spark):
    chain = "e:F1 a owl:Class ; owl:equivalentClass " + some("e:likes", "e:Fun") + " . e:F2 a owl:Class ; owl:equivalentClass " + some("e:likes", "e:F1") + " . e:Chess a owl:Class ; rdfs:subClassOf e:Fun ."
    p = prepared(spark, chain, "e:g a e:Chess . e:a e:likes e:g . e:b e:likes e:a . e:c e:likes e:b .")
    assert members(modes.stratified(p, ["urn:e:F1", "urn:e:F2"])) == {"F1": {"a"}, "F2": {"b"}}
    # Pipes are wet by what feeds them, and leak by what they rest on; a ring without a leak stays dry.
    damp = "e:Wet a owl:Class ; owl:equivalentClass " + some("e:fedBy", "e:Leaking") + " . e:Leaking a owl:Class ; owl:equivalentClass " + some("e:restsOn", "e:Wet") + " ."
    pipes = "e:valve a e:Leaking . e:p1 e:fedBy e:valve . e:p2 e:restsOn e:p1 . e:p3 e:fedBy e:p2 ; e:restsOn e:p1 . e:p4 e:restsOn e:p3 . e:r1 e:fedBy e:r2 . e:r2 e:restsOn e:r1 ."
    p = prepared(spark, damp, pipes)
    assert members(modes.stratified(p, ["urn:e:Wet", "urn:e:Leaking"])) == {"Wet": {"p1", "p3"}, "Leaking": {"valve", "p2", "p3", "p4"}}
    p = prepared(spark, "e:Gauge a owl:Class ; rdfs:subClassOf " + some("e:reads", "e:Tank") + " .", "e:g1 e:reads e:t1 . e:t1 a e:Tank . e:g2 e:reads e:g1 .")
    assert members(modes.stratified(p, ["urn:e:Gauge"])) == {} and members(modes.materialize_definitions(p, ["urn:e:Gauge"])[1]) == {"Gauge": {"g1"}}


def test_unions_in_conclusions(spark):
    """What is of one of some kinds is of what covers them all, without its kind being known."""
    kinds = "[ owl:unionOf ( e:Barge e:Tug e:Ferry ) ]"
    p = prepared(spark, f"e:Vessel rdfs:subClassOf {kinds} . {kinds} rdfs:subClassOf e:Insured . e:Insured rdfs:subClassOf e:Listed . e:Raft rdfs:subClassOf e:Floating .", "e:v a e:Vessel . e:t a e:Tug . e:r a e:Raft .")
    assert members(modes.stratified(p, ["urn:e:Insured", "urn:e:Listed"])) == {"Insured": {"v", "t"}, "Listed": {"v", "t"}}


def test_equality(spark):
    """A class of one ship makes its members that ship; names meet by statements, keys and what follows from both."""
    schema = "e:Flagship a owl:Class ; owl:equivalentClass [ owl:oneOf ( e:aurora ) ] . e:Pennant rdfs:subClassOf e:Flagship . e:Hull owl:hasKey ( e:yard e:number ) . e:Hull a owl:Class ."
    ships = """e:aurora a e:Hull ; e:yard e:kiel ; e:number "41" . e:boreas owl:sameAs e:aurora . e:cygnus a e:Hull ; e:yard e:harbour ; e:number "41" . e:harbour owl:sameAs e:kiel .
        e:dorado a e:Hull ; e:yard e:kiel ; e:number "42" . e:echo e:yard e:kiel ; e:number "41" . e:rival a e:Pennant . e:rival owl:differentFrom e:aurora ."""
    p = prepared(spark, schema, ships)
    assert members(modes.stratified(p, ["urn:e:Flagship"])) == {"Flagship": {"aurora", "boreas", "cygnus"}}
    status = {r.id: r for r in modes.stratified(p, ["urn:e:Flagship"], status=True).collect()}
    assert status["urn:e:rival"].derived and status["urn:e:rival"].conflicted
    with pytest.raises(Conflict):
        modes.stratified(p, ["urn:e:Flagship"], policy="strict_fail_on_conflict")
    p = prepared(spark, schema, "e:pretender a e:Pennant . e:other a e:Hull .")
    assert members(modes.stratified(p, ["urn:e:Flagship"])) == {"Flagship": {"aurora", "pretender"}}


def test_keys_run_to_the_end(spark):
    """Each pair of twins has the pair before as its key: seven rounds, one for each pair."""
    n = 7
    data = "e:x0 owl:sameAs e:y0 . " + " ".join(f"e:{s}{k} a e:Twin ; e:after e:{s}{k - 1} ." for s in "xy" for k in range(1, n + 1)) + f" e:z a e:Twin ; e:after e:q . e:x{n} a e:Last ."
    p = prepared(spark, "e:Twin a owl:Class ; owl:hasKey ( e:after ) . e:Last a owl:Class . e:Final a owl:Class . e:Last rdfs:subClassOf e:Final .", data)
    assert members(modes.stratified(p, ["urn:e:Final"])) == {"Final": {f"x{n}", f"y{n}"}}
    with pytest.raises(NotConverged):
        s = Schema.from_triples(parse_turtle(PREFIX + "e:Twin a owl:Class ; owl:hasKey ( e:after ) ."))
        modes.prepare(facts_from_triples(triples_frame(spark, parse_turtle(PREFIX + data, "d"))), s, rounds=3)


def test_complements_run_to_the_end(spark):
    """What isn't in one class is in its complement, which excludes the next one, and so on."""
    n = 6
    schema = " ".join(f"e:In{k} a owl:Class ; owl:equivalentClass [ owl:complementOf e:Out{k} ] . e:Step{k} a owl:Class ; rdfs:subClassOf e:In{k} ; owl:disjointWith e:Out{k + 1} ." for k in range(n))
    schema += " ".join(f" e:In{k} rdfs:subClassOf e:Go{k} . e:Go{k} rdfs:subClassOf e:Step{k} ." for k in range(n))
    p = prepared(spark, schema, "e:a a e:Step0 . e:b a e:Go3 . e:c a e:Out1 .")
    got = members(modes.stratified(p, [f"urn:e:In{n - 1}", "urn:e:In2"]))
    assert got == {f"In{n - 1}": {"a", "b"}, "In2": {"a"}}
    with pytest.raises(NotConverged):
        modes.stratified(p, [f"urn:e:In{n - 1}"], rounds=3)


def test_negative_evidence(spark):
    """A denied value, a second value of a functional property, and what a disjoint class or a denied type excludes."""
    schema = """e:licence a owl:ObjectProperty . e:berth a owl:FunctionalProperty .
        e:NightPilot a owl:Class ; owl:equivalentClass [ a owl:Restriction ; owl:onProperty e:licence ; owl:hasValue e:night ] .
        e:AtNorth a owl:Class ; owl:equivalentClass [ a owl:Restriction ; owl:onProperty e:berth ; owl:someValuesFrom [ owl:oneOf ( "N1" ) ] ] .
        e:Idle a owl:Class ; owl:equivalentClass [ owl:complementOf e:Loading ] . e:Drydocked owl:disjointWith e:Loading . e:Overhaul rdfs:subClassOf e:Drydocked ."""
    data = """e:maria e:licence e:night , e:tug . e:jonas e:licence e:night . e:petra e:licence e:tug .
        [] a owl:NegativePropertyAssertion ; owl:sourceIndividual e:jonas ; owl:assertionProperty e:licence ; owl:targetIndividual e:night .
        e:s1 e:berth "N1" . e:s2 e:berth "N1" , "S4" . e:s3 e:berth "S4" . e:s4 a e:Overhaul . e:s5 a [ owl:complementOf e:Loading ] . e:s6 a e:Loading ."""
    p = prepared(spark, schema, data)
    assert members(modes.stratified(p, ["urn:e:NightPilot", "urn:e:AtNorth", "urn:e:Idle"])) == {"NightPilot": {"maria"}, "AtNorth": {"s1"}, "Idle": {"s4", "s5"}}


def test_domains_and_ranges(spark):
    """With its properties' ranges as conditions, a farm grows what is a crop, on an area that can be one."""
    schema = """e:Orchard rdfs:subClassOf e:Farm . e:grows rdfs:domain e:Farm ; rdfs:range [ owl:unionOf ( e:Grain e:Fruit ) ] .
        e:acres rdfs:domain e:Farm ; rdfs:range [ a rdfs:Datatype ; owl:onDatatype xsd:decimal ; owl:withRestrictions ( [ xsd:minExclusive 0.0 ] [ xsd:maxInclusive 500.0 ] ) ] ."""
    data = """e:f1 e:grows e:wheat ; e:acres 12.5 . e:wheat a e:Grain . e:f2 a e:Orchard ; e:acres 700.5 . e:f3 e:grows e:gravel . e:f4 a e:Orchard ; e:acres 500.0 .
        e:f5 e:acres 0.0 . e:f6 e:grows e:wheat , e:gravel . e:f7 a e:Orchard ."""
    got = members(modes.admissibility(prepared(spark, schema, data), ["urn:e:Farm"], augment=True))
    assert got == {"Farm": {"f1", "f4", "f7"}}


def test_refusals_and_targets():
    s = Schema.from_triples(parse_turtle(PREFIX + "e:A a owl:Class ; owl:equivalentClass [ owl:complementOf " + some("e:p", "e:A") + " ] . e:B a owl:Class ; rdfs:subClassOf " + some("e:p", "e:C") + " . e:p a owl:SymmetricProperty ."))
    kept, skipped = modes.resolve_targets(s, ["all-defined-classes"])
    assert kept == ["urn:e:B"] and "negation" in skipped["urn:e:A"] and any("Symmetric" in x for x in s.skipped)
    assert modes.support(s, ["urn:e:B"]) == {"urn:e:B": False}


def test_explanation(spark):
    p = prepared(spark, "e:R a owl:Class ; rdfs:subClassOf " + some("e:p", "e:T") + " . e:p a owl:TransitiveProperty .", "e:a e:p e:b . e:b e:p e:c . e:c a e:T .")
    d = Dag()
    c = Compiler(p.schema, d)
    root = c.necessary("urn:e:R")
    reason = explain(p.facts.graph, d, root, "urn:e:a")
    assert reason.score == 1.0 and reason.path == ["urn:e:a", "urn:e:b", "urn:e:c"]
    root = d.exists("urn:e:p", d.atomic("urn:e:T"))
    reason = explain(p.facts.graph, d, root, "urn:e:b")
    assert [n for n, _ in reason.neighbours] == ["urn:e:c"] and "exists of urn:e:b: 1" in reason.lines()[0]
