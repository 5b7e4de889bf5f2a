"""Attack types inferred from indicators by fractional rule matching."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from importlib.resources import files

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.functions.text import property_title
from heron.plans.session import cut
from heron.sources.turtle import RDF, triples

#: The vocabularies of rule files.
NS, OWL, RDFS = "http://example.org/mail-risk#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2000/01/rdf-schema#"
ROOT = f"{NS}PhishingAttack"
_RULE = [f"{NS}allOf", f"{NS}anyOf", f"{NS}indicator", f"{RDF}first", f"{RDF}rest"]
_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Rules:
    """attack -> (all of, any of), and the property of each indicator's name."""

    attacks: dict[str, tuple[list[str], list[str]]]
    properties: dict[str, str]


def local(address: str) -> str:
    return address.rpartition("#")[2]


def rules_of(rows: list[tuple], attacks: list[str] | None = None) -> Rules:
    """The rules that triples state about attacks (None: about all subjects that have a rule)."""
    said: dict[str, dict[str, list[str]]] = {}
    for subject, predicate, value, *_ in rows:
        if predicate in _RULE:
            said.setdefault(subject, {}).setdefault(predicate, []).append(value)

    def listed(subject: str, predicate: str) -> list[str]:
        out, seen = [], set()
        for node in said.get(subject, {}).get(predicate, []):
            while node != f"{RDF}nil":
                if node in seen or len(said.get(node, {}).get(f"{RDF}first", [])) != 1 or len(said[node].get(f"{RDF}rest", [])) != 1:
                    raise ValueError(f"{predicate} of {subject} is no list")
                seen.add(node)
                out.append(local(said[node][f"{RDF}first"][0]))
                node = said[node][f"{RDF}rest"][0]
        return out

    have = sorted(s for s, x in said.items() if (attacks is None or s in attacks) and (_RULE[0] in x or _RULE[1] in x))
    names = {value: local(s) for s, x in said.items() for value in x.get(_RULE[2], [])}
    return Rules({local(s): (listed(s, _RULE[0]), listed(s, _RULE[1])) for s in have}, names)


#: The rules of the package's own file.
TEXT = files("heron.operators").joinpath("attacks.ttl").read_text(encoding="utf-8")
DEFAULT = rules_of(triples(TEXT))
ATTACKS, PROPERTIES = DEFAULT.attacks, DEFAULT.properties


def load_rules(spark: SparkSession, path: str) -> Rules | None:
    """The rules of the attack types in the Turtle files under path; None, with a warning, where there are no such files, they are no Turtle or their rules are broken."""
    from heron.sources.turtle import read_turtle

    try:
        rows = cut(read_turtle(spark, path), "triples")
        attacks = [NS + r["attack_type"] for r in attack_types(rows).join(rows.filter(F.col("predicate").isin(_RULE[:2])).select(_name("subject").alias("attack_type")), "attack_type", "left_semi").collect()]
        return rules_of([tuple(r) for r in rows.filter(F.col("predicate").isin(_RULE)).collect()], attacks)
    except (AnalysisException, PySparkException, ValueError) as e:
        _log.warning("no rules from %s: %s", path, str(e).splitlines()[0])
        return None


def _name(column: str) -> Column:
    return F.substring_index(column, "#", -1)


def subclass_closure(edges: DataFrame, root: str) -> DataFrame:
    """All classes below root in (child, parent) edges, however deep they lie, without root; a level at a time, until one brings no new class."""
    edges = edges.filter("child <> parent")
    level = cut(edges.filter((F.col("parent") == root) & (F.col("child") != root)).select(F.col("child").alias("attack_type")).distinct(), "classes")
    found = level
    while not level.isEmpty():
        below = edges.join(level, F.col("parent") == F.col("attack_type")).select(F.col("child").alias("attack_type")).filter(F.col("attack_type") != root).distinct()
        level = cut(below.join(found, "attack_type", "left_anti"), "classes")
        found = found.unionByName(level)
    return found


def attack_types(rows: DataFrame, root: str = ROOT) -> DataFrame:
    """attack_type: the names of all classes below root in a table of triples."""
    edges = rows.filter(F.col("predicate") == f"{RDFS}subClassOf").select(F.col("subject").alias("child"), F.col("object").alias("parent"))
    return subclass_closure(edges, root).select(_name("attack_type").alias("attack_type"))


def ontology_stats(rows: DataFrame, root: str = ROOT) -> DataFrame:
    """One row: distinct triples, attack types, classes and properties of a table of triples."""
    kind = lambda k: F.countDistinct(F.when((F.col("predicate") == f"{RDF}type") & (F.col("object") == f"{OWL}{k}"), F.col("subject")))
    counts = rows.distinct().agg(F.count("*").alias("total_triples"), kind("Class").alias("classes"), kind("DatatypeProperty").alias("properties"))
    # One row of each.
    return counts.crossJoin(attack_types(rows, root).agg(F.count("*").alias("attack_types"))).select("total_triples", "attack_types", "classes", "properties")


def observed(seen: DataFrame) -> DataFrame:
    """Triples that make a class of each (attack_type, variant) that was seen, below its attack type."""
    class_ = F.concat(F.lit(NS), "attack_type", F.lit("."), "variant")
    iri, none = F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("datatype")
    seen = seen.distinct()
    kinds = seen.select(class_.alias("subject"), F.lit(f"{RDF}type").alias("predicate"), F.lit(f"{OWL}Class").alias("object"), iri, none)
    return kinds.unionByName(seen.select(class_.alias("subject"), F.lit(f"{RDFS}subClassOf").alias("predicate"), F.concat(F.lit(NS), "attack_type").alias("object"), iri, none))


def properties() -> Column:
    """The distinct properties of a row of rule_hits(), in the order of the indicators."""
    def on(cond, name):
        return F.when(cond, F.lit(PROPERTIES[name]))

    return F.array_distinct(F.array_compact(F.array(
        on(F.col("urgency") > 0, "urgency"), on(F.col("creds_request") > 0, "creds_request"), on(F.col("freemail_sender") | (F.col("freemail_brand_claim") > 0), "freemail_sender"),
        on(F.col("missing_mx") > 0, "missing_mx"), on(F.col("no_spf") > 0, "no_spf"), on(F.col("no_dmarc") > 0, "no_dmarc"),
        on(F.col("ip_literal_link") > 0, "ip_literal_link"), on(F.col("shortened_url") > 0, "shortened_url"),
        on(F.col("domain_mismatch") | (F.col("lookalike_domain") > 0), "domain_mismatch"),
    )))


def infer(df: DataFrame, props: str = "properties", minimum: float = 0.3, strict: bool = False, rules: Rules | None = DEFAULT) -> DataFrame:
    """df with attacks, an array of (attack_type, confidence) by falling confidence, then name; empty where there are no rules (None)."""
    found = [F.lit(None).cast("struct<order:double,attack_type:string,confidence:double>")]
    for name, (all_of, some) in (rules.attacks if rules else {}).items():
        if not all_of and not some:
            continue
        has = F.array_intersect(F.array(*map(F.lit, all_of)), F.col(props))
        met = F.arrays_overlap(F.array(*map(F.lit, some)), F.col(props)).cast("int") if some else F.lit(0)
        confidence = (F.size(has) + met) / F.lit(float(len(all_of) + bool(some)))
        least = 1.0 if strict else minimum
        on = (F.size(has) + met > 0) & (confidence >= least) & ((met > 0) if some else F.lit(True))
        found.append(F.when(on, F.struct((-confidence).alias("order"), F.lit(name).alias("attack_type"), confidence.alias("confidence"))))
    ordered = F.array_sort(F.array_compact(F.array(*found)))
    return df.withColumn("attacks", F.transform(ordered, lambda a: F.struct(a["attack_type"].alias("attack_type"), a["confidence"].alias("confidence"))))


def explanation(props: Column, attacks: Column, rules: Rules = DEFAULT) -> Column:
    """What was detected, the best attack's rule and the conclusion, as lines; the detected ones alone without an attack."""
    detected = F.transform(props, lambda p: F.concat(F.lit("✓ Detected: "), property_title(p)))
    rule = F.create_map(*(x for name, (a, b) in rules.attacks.items() for x in (F.lit(name), F.lit(_rule_text(a, b)))))
    best = F.try_element_at(attacks, F.lit(1))
    lines = F.array(
        F.concat(F.lit("⚙ Rule: "), best["attack_type"], F.lit(" requires "), F.element_at(rule, best["attack_type"])),
        F.concat(F.lit("✓ Conclusion: Classified as "), best["attack_type"], F.lit(" (confidence: "), F.bround(best["confidence"] * 100).cast("int").cast("string"), F.lit("%)")),
    )
    return F.when(F.size(attacks) > 0, F.concat(detected, lines)).otherwise(detected)


def _title(name: str) -> str:
    return "".join(f" {c}" if c.isupper() else c for c in name.removeprefix("has")).strip()


def _rule_text(all_of: list[str], some: list[str]) -> str:
    every, either = " AND ".join(map(_title, all_of)), " OR ".join(map(_title, some))
    return f"{every} AND ({either})" if every and either else every or either
