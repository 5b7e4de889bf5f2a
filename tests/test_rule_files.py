"""Turtle files, the rules in them, and lookups by raw answers."""

import pytest

from heron.operators import ontology
from heron.sources.messages import ANSWER, dns_answers, dns_facts
from heron.sources.turtle import RDF, XSD, TRIPLE, TurtleError, read_turtle, triples, write_turtle

TEXT = '''@base <http://e.org/a/> . PREFIX p: <http://p/>   # a comment with "quotes" and <marks>
<x> p:q "a\\"b\\u00e9"@EN , """two
 "lines" """ , 5 , -1.5 , 2e3 , true , "z"^^p:t ; a p:C ; .
<#y> p:r [ p:s ( 1 'two' ) ] . _:b1 p:q () . p:a.b p:c p:d\\,e.
[ p:alone true ] .
<x> p:q 5 .'''


def test_turtle_terms():
    x, q = "http://e.org/a/x", "http://p/q"
    found = triples(TEXT, "f")
    assert [t[2:] for t in found if t[:2] == (x, q)] == [
        ('a"bé', "literal", "@en"), ('two\n "lines" ', "literal", None), ("5", "literal", f"{XSD}integer"), ("-1.5", "literal", f"{XSD}decimal"),
        ("2e3", "literal", f"{XSD}double"), ("true", "literal", f"{XSD}boolean"), ("z", "literal", "http://p/t"),
    ]
    assert (x, f"{RDF}type", "http://p/C", "iri", None) in found and ("http://p/a.b", "http://p/c", "http://p/d,e", "iri", None) in found
    nodes = {(t[0], t[1]): t[2] for t in found}
    inner = nodes["http://e.org/a/#y", "http://p/r"]
    first = nodes[inner, "http://p/s"]
    assert nodes[first, f"{RDF}first"] == "1" and nodes[nodes[first, f"{RDF}rest"], f"{RDF}first"] == "two"
    assert nodes[nodes[first, f"{RDF}rest"], f"{RDF}rest"] == nodes["_:f#b1", q] == f"{RDF}nil"
    assert len(found) == len(set(found)) == 17 and triples("") == triples(" # nothing") == []


@pytest.mark.parametrize("bad", ["x", "<a> <b> .", '<a> <b> "c', "p:a p:b p:c .", "<a> <b> <c>", '"s" <b> <c> .', '<a> "p" <c> .', "<a> _:p <c> .", "@prefix p: .", "<a> <b> ( <c> .", '<a> <b> "\\q" .', "<a> <b> [ <c> <d> ."])
def test_broken_turtle(bad):
    with pytest.raises(TurtleError):
        triples(bad)


def test_turtle_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ttl").write_text(TEXT)
    (tmp_path / "in" / "b.ttl").write_text("<http://e.org/a/x> a <http://p/C> . _:b1 <http://p/q> _:b2 .")
    rows = read_turtle(spark, f"file://{tmp_path}/in")
    assert rows.count() == 18 and {r["subject"] for r in rows.collect()} >= {"_:a.ttl#b1", "_:b.ttl#b1"}
    write_turtle(rows, f"file://{tmp_path}/out")
    again = read_turtle(spark, f"file://{tmp_path}/out")
    shape = lambda df: sorted((*("_" if x.startswith("_:") else x for x in (r["subject"], r["predicate"], r["object"])), r["kind"], r["datatype"] or "") for r in df.collect())
    assert shape(again) == shape(rows)


def test_rules_come_from_the_file(spark, tmp_path):
    assert len(ontology.ATTACKS) == 8 and ontology.ATTACKS["URLBasedAttack"] == (["hasDomainMismatch"], ["hasIPLiteralURL", "hasShortenedURL"])
    assert len(ontology.PROPERTIES) == 10 and ontology.PROPERTIES["freemail_brand_claim"] == ontology.PROPERTIES["freemail_sender"] == "hasFreemailSender"
    (tmp_path / "rules.ttl").write_text(ontology.TEXT + "\n:Slow a owl:Class ; rdfs:subClassOf :CredentialTheft ; :anyOf ( :hasMissingSPF :hasMissingMX ) .\n:Other :allOf ( :hasMissingMX ) .")
    rules = ontology.load_rules(spark, f"file://{tmp_path}/rules.ttl")
    assert rules.attacks == ontology.ATTACKS | {"Slow": ([], ["hasMissingSPF", "hasMissingMX"])} and rules.properties == ontology.PROPERTIES
    df = spark.createDataFrame([(["hasMissingMX"],)], "properties array<string>")
    assert {a["attack_type"]: a["confidence"] for a in ontology.infer(df, rules=rules).first()["attacks"]} == {"Slow": 1.0, "CredentialTheft": 0.5, "TechnicalAttack": 0.5}


def test_broken_rule_files_give_no_rules(spark, tmp_path):
    assert ontology.load_rules(spark, f"file://{tmp_path}/missing.ttl") is None
    for name, text in (("a", "this is no Turtle"), ("b", ontology.TEXT + "\n:Bad a owl:Class ; rdfs:subClassOf :PhishingAttack ; :allOf :hasMissingMX .")):
        (tmp_path / f"{name}.ttl").write_text(text)
        assert ontology.load_rules(spark, f"file://{tmp_path}/{name}.ttl") is None
    df = spark.createDataFrame([(["hasMissingMX"],)], "properties array<string>")
    assert ontology.infer(df, rules=None).first()["attacks"] == []


def test_closure_of_any_depth_and_of_rings(spark):
    edges = [(f"c{i + 1}", f"c{i}") for i in range(40)] + [("c3", "c3"), ("c0", "c7"), ("x", "y"), ("y", "x")]
    found = ontology.subclass_closure(spark.createDataFrame(edges, "child string, parent string"), "c0")
    assert sorted(r["attack_type"] for r in found.collect()) == sorted(f"c{i + 1}" for i in range(40))
    assert ontology.subclass_closure(spark.createDataFrame([], "child string, parent string"), "c0").count() == 0


def test_stats_of_triples(spark):
    rows = spark.createDataFrame(triples(ontology.TEXT), TRIPLE)
    assert tuple(ontology.ontology_stats(rows.unionByName(rows)).first()) == (81, 8, 9, 9)


def test_facts_of_answers(spark):
    rows = [
        (1, "a.com", "MX", "10 m", None), (2, "a.com", "TXT", "x=1", None), (3, "a.com", "TXT", "V=SPF1 -all", None), (4, "_dmarc.A.com", "TXT", "v=DMARC1; sp=none; p=reject", None),
        (5, "_dmarc.a.com", "TXT", "v=DMARC1; p=none", None), (6, "b.com", "MX", None, "NXDOMAIN"), (7, "b.com", "TXT", " v=spf1", None), (8, "_dmarc.b.com", "TXT", "v=spf1", None),
        (9, "_dmarc.b.com", "TXT", "v=DMARC1; p=reject", "SERVFAIL"), (10, "c.com", "TXT", None, None), (11, "_dmarc.c.com", "TXT", "v=dmarc1; rua=x; p=", None),
    ]
    found = {r["domain"]: tuple(r)[1:] for r in dns_facts(spark.createDataFrame(rows, ANSWER)).collect()}
    assert found == {"a.com": (True, True, True, "reject"), "b.com": (False, False, False, "none"), "c.com": (False, False, True, "none")}
    assert dns_facts(spark.createDataFrame([], ANSWER)).count() == 0
    known = {r["domain"]: tuple(r)[1:] for r in dns_facts(dns_answers(spark)).collect()}
    assert known["acm3.com"] == (False, False, False, "none") and known["corp4.example.com"] == (True, True, True, "quarantine") and known["corp1.example.com"] == (True, False, False, "none")
