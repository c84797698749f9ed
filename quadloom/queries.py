"""The registered queries: each operator of the engine over the relational tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.engine import Engine, Profile, divided
from quadloom.functions.datatypes import canonical, value_key
from quadloom.operators import consumer, emit, quantities, shape_plan
from quadloom.operators.paths import Path, evaluate
from quadloom.operators.shacl import Validator
from quadloom.plans import relational as R
from quadloom.plans import sql
from quadloom.plans.timed import timed_fixpoint
from quadloom.sources import nquads
from quadloom.sources.rdf import parse_triples
from quadloom.terms import datatype_of, lexical_form, make_literal, skolem_iri
from quadloom.vocab import CDT, PREFIXES, TYPE, XSD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

HEAD = "".join(f"@prefix {k}: <{v}> .\n" for k, v in PREFIXES.items()) + f"@prefix t: <{R.BASE}> .\n@prefix x: <urn:x:> .\n"
T = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
STR = "^^<http://www.w3.org/2001/XMLSchema#string>"


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def key(table: str, column: str) -> str:
    """SQL of a row's term."""
    return f"'<{R.BASE}{table}/' || {column} || '>'"


def text(column: str) -> str:
    return f"""'"' || {column} || '"{STR}'"""


def derive(spark: SparkSession, facts: DataFrame, ontology: str, mode: str = "application", profiles=("owl2rl",), **options) -> DataFrame:
    return Engine(spark, mode).load(HEAD + ontology, list(profiles)).infer(facts, **options).select("s", "p", "o")


def iri_of(name: str) -> str:
    return f"<urn:x:{name}>"


# --- entailment -----------------------------------------------------------------------------------------------------


@query(f"""SELECT DISTINCT {key('customer', 'c_custkey')} AS s, '{T}' AS p, '<urn:x:Party>' AS o FROM customer
    UNION SELECT DISTINCT {key('nation', 'c_nationkey')}, '{T}', '<urn:x:Place>' FROM customer WHERE c_nationkey IS NOT NULL
    UNION SELECT DISTINCT {key('nation', 'c_nationkey')}, '{T}', '<urn:x:Thing>' FROM customer WHERE c_nationkey IS NOT NULL""")
def domain_range_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "customer", ["c_nationkey"])
    return derive(spark, facts, "t:c_nationkey rdfs:domain x:Party; rdfs:range x:Place. x:Place rdfs:subClassOf x:Thing.")


@query(f"""WITH RECURSIVE h(c, d) AS (VALUES ('O', 'OpenOrder'), ('F', 'FinishedOrder'), ('P', 'PendingOrder'), ('OpenOrder', 'LiveOrder'), ('PendingOrder', 'LiveOrder'), ('LiveOrder', 'Order'), ('FinishedOrder', 'Order')),
    r AS (SELECT c, d FROM h UNION SELECT r.c, h.d FROM r JOIN h ON h.c = r.d)
    SELECT DISTINCT {key('orders', 'o_orderkey')} AS s, '{T}' AS p, '<urn:x:' || d || '>' AS o FROM orders JOIN r ON r.c = o_orderstatus""")
def subclass_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "orders", ["o_orderstatus"])
    typed = facts.select("msg_id", "s", F.lit(TYPE).alias("p"), F.concat(F.lit("<urn:x:"), lexical_form(F.col("o")), F.lit(">")).alias("o"))
    return derive(spark, typed, "x:O rdfs:subClassOf x:OpenOrder. x:F rdfs:subClassOf x:FinishedOrder. x:P rdfs:subClassOf x:PendingOrder. x:OpenOrder rdfs:subClassOf x:LiveOrder. x:PendingOrder rdfs:subClassOf x:LiveOrder. x:LiveOrder rdfs:subClassOf x:Order. x:FinishedOrder rdfs:subClassOf x:Order.")


@query(f"""SELECT {key('orders', 'o_orderkey')} AS s, '<urn:x:party>' AS p, {key('customer', 'o_custkey')} AS o FROM orders
    UNION SELECT {key('orders', 'o_orderkey')}, '<urn:x:related>', {key('customer', 'o_custkey')} FROM orders
    UNION SELECT {key('customer', 'o_custkey')}, '<urn:x:ordered>', {key('orders', 'o_orderkey')} FROM orders
    UNION SELECT {key('orders', 'o_orderkey')}, '<urn:x:buyer>', {key('customer', 'o_custkey')} FROM orders""")
def subproperty_inverse_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "orders", ["o_custkey"])
    return derive(spark, facts, "t:o_custkey rdfs:subPropertyOf x:party; owl:inverseOf x:ordered; owl:equivalentProperty x:buyer. x:party rdfs:subPropertyOf x:related.")


@query(f"""WITH e AS (SELECT {key('nation', 'n_nationkey')} AS a, {key('region', 'n_regionkey')} AS b FROM nation)
    SELECT DISTINCT b AS s, '<urn:t:n_regionkey>' AS p, a AS o FROM e""")
def symmetric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, R.statements(spark, sf_dir, "nation", ["n_regionkey"]), "t:n_regionkey a owl:SymmetricProperty.")


@query(f"""SELECT DISTINCT {key('customer', 'c_custkey')} AS s, '<urn:x:inRegion>' AS p, {key('region', 'n_regionkey')} AS o FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def property_chain_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.several(spark, sf_dir, {"customer": ["c_nationkey"], "nation": ["n_regionkey"]})
    return derive(spark, facts, "x:inRegion owl:propertyChainAxiom (t:c_nationkey t:n_regionkey).")


@query(f"""SELECT DISTINCT {key('orders', 'o_orderkey')} AS s, '<urn:x:orderRegion>' AS p, {key('region', 'n_regionkey')} AS o
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def property_chain_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.several(spark, sf_dir, {"orders": ["o_custkey"], "customer": ["c_nationkey"], "nation": ["n_regionkey"]})
    return derive(spark, facts, "x:orderRegion owl:propertyChainAxiom (t:o_custkey t:c_nationkey t:n_regionkey).")


@query("""WITH RECURSIVE e AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
    r AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b WHERE e.b IS NOT NULL)
    SELECT '<urn:t:events/' || a || '>' AS s, '<urn:x:before>' AS p, '<urn:t:events/' || b || '>' AS o FROM r
    EXCEPT SELECT '<urn:t:events/' || a || '>', '<urn:x:before>', '<urn:t:events/' || b || '>' FROM e""")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, successors(spark, sf_dir), "x:before a owl:TransitiveProperty.")


def successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = events.withColumn("b", after).where("b is not null")
    return rows.select(F.lit(0).cast("long").alias("msg_id"), R.iri("events", F.col("event_id")).alias("s"), F.lit(iri_of("before")).alias("p"), R.iri("events", F.col("b")).alias("o"))


@query("""WITH e AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
    SELECT '<urn:t:events/' || a || '>' AS a, '<urn:t:events/' || b || '>' AS b FROM e WHERE b IS NOT NULL""")
def path_alternative_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """before | ^^before: both alternatives give the same pairs, once."""
    step = Path("predicate", iri_of("before"))
    return evaluate(Path("alternative", parts=(step, Path("inverse", parts=(Path("inverse", parts=(step,)),)))), successors(spark, sf_dir)).select("a", "b")


@query("""WITH RECURSIVE e AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
    g AS (SELECT a, b FROM e WHERE b IS NOT NULL),
    r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b)
    SELECT '<urn:t:events/' || a || '>' AS a, '<urn:t:events/' || b || '>' AS b FROM
      (SELECT a, b FROM r UNION SELECT a, a FROM g UNION SELECT b, b FROM g)""")
def path_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(Path("*", parts=(Path("predicate", iri_of("before")),)), successors(spark, sf_dir)).select("a", "b")


@query(f"""SELECT {key('part', 'a.p_partkey')} AS s, {key('part', 'b.p_partkey')} AS o FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey <> b.p_partkey""")
def same_as_inverse_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share a name are the same if the name identifies them."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    facts = parts.select(F.lit(0).cast("long").alias("msg_id"), R.iri("part", F.col("p_partkey")).alias("s"), F.lit(R.predicate("p_name")).alias("p"), make_literal(F.col("p_name"), XSD.string).alias("o"))
    out = derive(spark, facts, "t:p_name a owl:InverseFunctionalProperty.")
    return out.where((F.col("p") == "<http://www.w3.org/2002/07/owl#sameAs>")).select("s", "o")


@query(f"""SELECT {key('nation', 'a.n_nationkey')} AS s, {key('nation', 'b.n_nationkey')} AS o FROM nation a JOIN nation b
    ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def same_as_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region has one seat, so the nations that are named as such are the same."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    facts = nation.select(F.lit(0).cast("long").alias("msg_id"), R.iri("region", F.col("n_regionkey")).alias("s"), F.lit(iri_of("seat")).alias("p"), R.iri("nation", F.col("n_nationkey")).alias("o"))
    out = derive(spark, facts, "x:seat a owl:FunctionalProperty.")
    return out.where(F.col("p") == "<http://www.w3.org/2002/07/owl#sameAs>").select("s", "o")


@query(f"""SELECT {key('part', 'a.p_partkey')} AS s, {key('part', 'b.p_partkey')} AS o FROM part a JOIN part b
    ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey""")
def key_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "part", ["p_brand", "p_type", "p_size"])
    typed = facts.select("msg_id", "s", F.lit(TYPE).alias("p"), F.lit(iri_of("Part")).alias("o")).distinct()
    rules = "{ ?a a x:Part; t:p_brand ?x; t:p_type ?y; t:p_size ?z. ?b a x:Part; t:p_brand ?x; t:p_type ?y; t:p_size ?z. ?a log:notEqualTo ?b } => { ?a x:sameKey ?b }."
    out = derive(spark, facts.unionByName(typed), "", profiles=[Profile(HEAD + rules)])
    return out.select("s", "o")


@query(f"""SELECT {key('customer', 'c_custkey')} AS s, c AS o FROM (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer), (VALUES ('<urn:x:Builder>'), ('<urn:x:HomeBuilder>')) v(c)
    WHERE c_mktsegment = 'BUILDING' AND (c = '<urn:x:Builder>' OR c_nationkey = 7)
    UNION SELECT {key('customer', 'c_custkey')}, '<urn:x:Home>' FROM customer WHERE c_nationkey = 7
    UNION SELECT {key('customer', 'c_custkey')}, '<urn:x:Either>' FROM customer WHERE c_nationkey = 7 OR c_mktsegment = 'BUILDING'""")
def intersection_union_has_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "customer", ["c_mktsegment", "c_nationkey"])
    ontology = """[ owl:onProperty t:c_mktsegment; owl:hasValue "BUILDING" ] rdfs:subClassOf x:Builder.
        [ owl:onProperty t:c_nationkey; owl:hasValue <urn:t:nation/7> ] rdfs:subClassOf x:Home.
        x:HomeBuilder owl:intersectionOf (x:Builder x:Home). x:Either owl:unionOf (x:Builder x:Home)."""
    return derive(spark, facts, ontology).where(F.col("p") == TYPE).select("s", "o")


@query(f"""SELECT {key('orders', 'o_orderkey')} AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3""")
def some_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.several(spark, sf_dir, {"orders": ["o_custkey"], "customer": ["c_nationkey"]})
    ontology = "[ owl:onProperty t:c_nationkey; owl:hasValue <urn:t:nation/3> ] rdfs:subClassOf x:Local. [ owl:onProperty t:o_custkey; owl:someValuesFrom x:Local ] rdfs:subClassOf x:LocalOrder."
    return derive(spark, facts, ontology).where(F.col("o") == iri_of("LocalOrder")).select("s")


@query(f"""SELECT DISTINCT {key('nation', 'n_nationkey')} AS s, '<urn:x:HomeNation>' AS o FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def all_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "customer", ["c_nationkey"])
    ontology = "t:c_nationkey rdfs:domain x:Customer. x:Customer rdfs:subClassOf [ owl:onProperty t:c_nationkey; owl:allValuesFrom x:HomeNation ]."
    return derive(spark, facts, ontology).where(F.col("o") == iri_of("HomeNation")).select("s", "o")


@query("""SELECT '<urn:t:user/' || user_id || '>' AS s FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5""")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users in every one of five classes: the long intersection, as one aggregation."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    facts = events.select(F.lit(0).cast("long").alias("msg_id"), R.iri("user", F.col("user_id")).alias("s"), F.lit(TYPE).alias("p"), F.concat(F.lit("<urn:x:"), "event_type", F.lit(">")).alias("o"))
    return divided(facts, iri_of("All"), [iri_of(x) for x in ("click", "error", "purchase", "signup", "view")]).select("s")


# --- contradictions -------------------------------------------------------------------------------------------------


def contradictions_in(spark: SparkSession, facts: DataFrame, ontology: str) -> DataFrame:
    found = Engine(spark).load(HEAD + ontology, ["owl2rl"]).inconsistencies(facts)
    return found.select(F.regexp_extract("rule", r":([^:>]+)>$", 1).alias("rule"), F.concat_ws(" ", "terms").alias("terms"))


@query("""SELECT 'cax-dw' AS rule, '<urn:x:click> <urn:x:error> <urn:t:user/' || user_id || '>' AS terms FROM events GROUP BY user_id HAVING bool_or(event_type = 'click') AND bool_or(event_type = 'error')""")
def disjoint_inconsistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    facts = events.select(F.lit(0).cast("long").alias("msg_id"), R.iri("user", F.col("user_id")).alias("s"), F.lit(TYPE).alias("p"), F.concat(F.lit("<urn:x:"), "event_type", F.lit(">")).alias("o"))
    return contradictions_in(spark, facts, "x:click owl:disjointWith x:error.")


@query(f"""SELECT 'prp-irp' AS rule, '<urn:x:peer> ' || {key('nation', 'n_nationkey')} AS terms FROM nation WHERE n_nationkey % 7 = n_nationkey
    UNION SELECT 'prp-asyp', '<urn:x:peer> ' || {key('nation', 'n_nationkey')} || ' ' || {key('nation', 'n_nationkey')} FROM nation WHERE n_nationkey % 7 = n_nationkey""")
def irreflexive_asymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    facts = nation.select(F.lit(0).cast("long").alias("msg_id"), R.iri("nation", F.col("n_nationkey")).alias("s"), F.lit(iri_of("peer")).alias("p"), R.iri("nation", F.col("n_nationkey") % 7).alias("o"))
    return contradictions_in(spark, facts, "x:peer a owl:IrreflexiveProperty, owl:AsymmetricProperty.")


@query(f"""SELECT 'prp-npa2' AS rule, '<urn:x:denied> <urn:t:region/1> <urn:t:r_name> ' || {text('r_name')} AS terms FROM region WHERE r_regionkey = 1 AND r_name = 'AMERICA'
    UNION ALL SELECT 'prp-npa1', '<urn:x:denied1> <urn:t:nation/3> <urn:t:n_regionkey> <urn:t:region/1>' FROM nation WHERE n_nationkey = 3 AND n_regionkey = 1
    UNION ALL SELECT 'cls-maxc1', '<urn:x:NoNation> ' || {key('nation', 'n_nationkey')} || ' <urn:t:n_regionkey> ' || {key('region', 'n_regionkey')} FROM nation WHERE n_regionkey = 2""")
def negative_assertion_max_card_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.several(spark, sf_dir, {"region": ["r_name"], "nation": ["n_regionkey"]})
    ontology = """x:denied a owl:NegativePropertyAssertion; owl:sourceIndividual <urn:t:region/1>; owl:assertionProperty t:r_name; owl:targetValue "AMERICA".
        x:denied1 owl:sourceIndividual <urn:t:nation/3>; owl:assertionProperty t:n_regionkey; owl:targetIndividual <urn:t:region/1>.
        x:InTwo owl:onProperty t:n_regionkey; owl:hasValue <urn:t:region/2>; rdfs:subClassOf x:NoNation.
        x:NoNation owl:onProperty t:n_regionkey; owl:maxCardinality 0 ."""
    return contradictions_in(spark, facts, ontology)


@query("""SELECT 'dt-not-type' AS rule, '"' || p_name || '"^^<http://www.w3.org/2001/XMLSchema#integer> <http://www.w3.org/2001/XMLSchema#integer>' AS terms FROM part
    WHERE NOT regexp_full_match(p_name, '[+-]?[0-9]+') GROUP BY p_name""")
def ill_typed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    facts = parts.select(F.lit(0).cast("long").alias("msg_id"), R.iri("part", F.col("p_partkey")).alias("s"), F.lit("<urn:x:code>").alias("p"), make_literal(F.col("p_name"), XSD.integer).alias("o"))
    return contradictions_in(spark, facts, "")


# --- thesaurus ------------------------------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT {key('customer', 'c_custkey')} AS a, {key('nation', 'c_nationkey')} AS b FROM customer UNION SELECT {key('nation', 'n_nationkey')}, {key('region', 'n_regionkey')} FROM nation),
    tc AS (SELECT a, b FROM e UNION SELECT x.a, y.b FROM e x JOIN e y ON x.b = y.a)
    SELECT a AS s, '<http://www.w3.org/2004/02/skos/core#broaderTransitive>' AS p, b AS o FROM tc
    UNION SELECT b, '<http://www.w3.org/2004/02/skos/core#narrowerTransitive>', a FROM tc
    UNION SELECT b, '<http://www.w3.org/2004/02/skos/core#narrower>', a FROM e
    UNION SELECT a, '{T}', '<http://www.w3.org/2004/02/skos/core#Concept>' FROM e UNION SELECT b, '{T}', '<http://www.w3.org/2004/02/skos/core#Concept>' FROM e
    UNION SELECT a, '<http://www.w3.org/2004/02/skos/core#semanticRelation>', b FROM tc UNION SELECT b, '<http://www.w3.org/2004/02/skos/core#semanticRelation>', a FROM tc""")
def skos_broader_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.several(spark, sf_dir, {"customer": ["c_nationkey"], "nation": ["n_regionkey"]})
    broader = facts.withColumn("p", F.lit("<http://www.w3.org/2004/02/skos/core#broader>"))
    return derive(spark, broader, "", profiles=["skos"])


@query(f"""SELECT DISTINCT {key('supplier', 's_suppkey')} AS s, '<http://www.w3.org/2000/01/rdf-schema#label>' AS p, {text('s_name')} AS o FROM supplier""")
def skos_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "supplier", ["s_name"]).withColumn("p", F.lit("<http://www.w3.org/2004/02/skos/core#prefLabel>"))
    return derive(spark, facts, "", profiles=["skos"])


@query(f"""WITH e AS (SELECT {key('supplier', 's_suppkey')} AS a, {key('nation', 's_nationkey')} AS b FROM supplier), m AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
    SELECT b AS s, '<http://www.w3.org/2004/02/skos/core#closeMatch>' AS p, a AS o FROM e
    UNION SELECT a, '<http://www.w3.org/2004/02/skos/core#mappingRelation>', b FROM m UNION SELECT a, '<http://www.w3.org/2004/02/skos/core#semanticRelation>', b FROM m
    UNION SELECT a, '{T}', '<http://www.w3.org/2004/02/skos/core#Concept>' FROM m""")
def skos_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """closeMatch is symmetric and a mapping relation, but not transitive."""
    facts = R.statements(spark, sf_dir, "supplier", ["s_nationkey"]).withColumn("p", F.lit("<http://www.w3.org/2004/02/skos/core#closeMatch>"))
    return derive(spark, facts, "", profiles=["skos"])


# --- quantities -----------------------------------------------------------------------------------------------------


def measured(spark: SparkSession, sf_dir: str, texts, datatype: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.lit(0).cast("long").alias("msg_id"), R.iri("events", F.col("event_id")).alias("s"), F.lit(iri_of("value")).alias("p"), make_literal(texts, datatype).alias("o"))


def normal_values(spark: SparkSession, facts: DataFrame, places: int = 6) -> DataFrame:
    units = Engine(spark).load("", ["qudt"]).units
    made = quantities.normalise(facts, units)
    node = made.where(F.col("p").endswith("normalizedQuantity>")).select("s", F.col("o").alias("q"))
    value = made.where(F.col("p").endswith("numericValue>")).select(F.col("s").alias("q"), F.round(lexical_form(F.col("o")).cast("double"), places).alias("value"))
    unit = made.where(F.col("p").endswith("/unit>")).select(F.col("s").alias("q"), F.regexp_extract("o", r"/([^/>]+)>$", 1).alias("unit"))
    return node.join(value, "q").join(unit, "q").select("s", "value", "unit")


@query("""SELECT '<urn:t:events/' || event_id || '>' AS s, round((CASE event_id % 3 WHEN 0 THEN CAST((event_id % 500) || '.5' AS DOUBLE) * 0.2777777777777778 WHEN 1 THEN CAST((event_id % 500) || '.5' AS DOUBLE) * CAST(0.44704 AS DOUBLE) ELSE CAST((event_id % 500) || '.5' AS DOUBLE) END), 6) AS value, 'M-PER-SEC' AS unit FROM events""")
def unit_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.concat((F.col("event_id") % 500).cast("string"), F.lit(".5"))
    unit = F.when(F.col("event_id") % 3 == 0, "km/h").when(F.col("event_id") % 3 == 1, "mi/h").otherwise("m/s")
    return normal_values(spark, measured(spark, sf_dir, F.concat(n, F.lit(" "), unit), CDT.speed))


@query("""SELECT '<urn:t:events/' || event_id || '>' AS s, round(CASE event_id % 2 WHEN 0 THEN CAST(event_id % 100 AS DOUBLE) + CAST(273.15 AS DOUBLE) ELSE (CAST(event_id % 100 AS DOUBLE) + CAST(459.67 AS DOUBLE)) * CAST(0.5555555555555556 AS DOUBLE) END, 6) AS value, 'K' AS unit FROM events""")
def unit_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("event_id") % 2 == 0, "Cel").otherwise("[degF]")
    return normal_values(spark, measured(spark, sf_dir, F.concat((F.col("event_id") % 100).cast("string"), F.lit(" "), unit), CDT.temperature))


@query("""SELECT '<urn:t:events/' || event_id || '>' AS s, round(CASE event_id % 3 WHEN 0 THEN pow(10.0, (event_id % 40) * CAST(0.1 AS DOUBLE)) WHEN 1 THEN pow(2.0, CAST(event_id % 40 AS DOUBLE)) ELSE pow(10.0, -CAST(event_id % 40 AS DOUBLE)) END, 4) AS value, 'UNITLESS' AS unit FROM events""")
def unit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("event_id") % 3 == 0, "dB").when(F.col("event_id") % 3 == 1, "oct").otherwise("pH")
    return normal_values(spark, measured(spark, sf_dir, F.concat((F.col("event_id") % 40).cast("string"), F.lit(" "), unit), CDT.ucum), 4)


@query("""SELECT '<urn:t:events/' || event_id || '>' AS s, round(ln(CAST(event_id % 1000 AS DOUBLE)) / ln(CAST(10.0 AS DOUBLE)) / CAST(0.1 AS DOUBLE), 6) AS value FROM events WHERE event_id % 1000 > 0""")
def unit_reverse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios whose focus asks for decibels; a ratio of zero has no value on that scale."""
    facts = measured(spark, sf_dir, F.concat((F.col("event_id") % 1000).cast("string"), F.lit(" 1")), CDT.dimensionless)
    asked = facts.select("msg_id", "s", F.lit("<urn:quadloom:quantity:targetLogarithmicUnit>").alias("p"), F.lit("<http://qudt.org/vocab/unit/DeciB>").alias("o"))
    made = quantities.normalise(facts.unionByName(asked), Engine(spark).load("", ["qudt"]).units)
    node = made.where(F.col("p").endswith("normalizedLogarithmicQuantity>")).select("s", F.col("o").alias("q"))
    return node.join(made.where(F.col("p").endswith("numericValue>")).select(F.col("s").alias("q"), F.round(lexical_form(F.col("o")).cast("double"), 6).alias("value")), "q").select("s", "value")


@query("""SELECT '<urn:t:events/' || event_id || '>' AS s, round(CAST(event_id % 100 AS DOUBLE) * CAST(0.01 AS DOUBLE), 6) AS value, 'M' AS unit FROM events WHERE event_type NOT IN ('view', 'click')""")
def unit_incompatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in centimetres and in kilograms: a mass is no length, so those give nothing."""
    unit = F.when(F.col("event_type").isin("view", "click"), " kg").otherwise(" cm")
    return normal_values(spark, measured(spark, sf_dir, F.concat((F.col("event_id") % 100).cast("string"), unit), CDT.length))


@query("""SELECT event_id, CASE WHEN ok THEN CAST(regexp_extract(t, '^\\s*([+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\\s+', 1) AS DOUBLE) END AS value,
    CASE WHEN ok THEN regexp_extract(t, '^\\s*[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?\\s+(.+?)\\s*$', 1) END AS unit
    FROM (SELECT *, regexp_matches(t, '^\\s*[+-]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?\\s+(.+?)\\s*$') AS ok FROM
      (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || (event_id % 90) || ' km/h ' WHEN 1 THEN '-.5e1 m' WHEN 2 THEN 'abc cm' ELSE '12' END AS t FROM events))""")
def quantity_literal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    texts = F.when(k == 0, F.concat(F.lit(" "), (F.col("event_id") % 90).cast("string"), F.lit(" km/h "))).when(k == 1, "-.5e1 m").when(k == 2, "abc cm").otherwise("12")
    value, unit = quantities.parse_quantity(texts)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", value.alias("value"), unit.alias("unit"))


# --- shapes ---------------------------------------------------------------------------------------------------------


def violations(spark: SparkSession, facts: DataFrame, shapes: str) -> DataFrame:
    found = Validator(parse_triples(HEAD + shapes)).validate(facts)
    return found.select("focus", F.regexp_extract("component", r"#(\w+)ConstraintComponent", 1).alias("component"), F.coalesce("value", F.lit("")).alias("value"))


@query(f"""SELECT '<urn:t:user/' || user_id || '>' AS focus, 'MaxCount' AS component, '' AS value FROM events GROUP BY user_id HAVING count(*) > 60
    UNION ALL SELECT '<urn:t:user/' || user_id || '>', 'MinCount', '' FROM events GROUP BY user_id HAVING count(*) < 70""")
def shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "events", ["user_id"])
    return violations(spark, facts, "x:S a sh:NodeShape; sh:targetObjectsOf t:user_id; sh:property [ sh:path [ sh:inversePath t:user_id ]; sh:minCount 70; sh:maxCount 60 ].")


@query(f"""SELECT {key('customer', 'c_custkey')} AS focus, 'In' AS component, {text('c_mktsegment')} AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE')
    UNION ALL SELECT {key('customer', 'c_custkey')}, 'Pattern', {text('c_mktsegment')} FROM customer WHERE NOT regexp_matches(c_mktsegment, '^(?i)b')
    UNION ALL SELECT {key('customer', 'c_custkey')}, 'MaxLength', {text('c_mktsegment')} FROM customer WHERE length(c_mktsegment) > 8
    UNION ALL SELECT {key('customer', 'c_custkey')}, 'MinLength', {text('c_mktsegment')} FROM customer WHERE length(c_mktsegment) < 9
    UNION ALL SELECT {key('customer', 'c_custkey')}, 'HasValue', '' FROM customer WHERE c_mktsegment <> 'MACHINERY'""")
def shape_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "customer", ["c_mktsegment"])
    return violations(spark, facts, 'x:S a sh:NodeShape; sh:targetSubjectsOf t:c_mktsegment; sh:property [ sh:path t:c_mktsegment; sh:in ("BUILDING" "AUTOMOBILE"); sh:pattern "^b"; sh:flags "i"; sh:maxLength 8; sh:minLength 9; sh:hasValue "MACHINERY" ].')


@query(f"""SELECT {key('part', 'p_partkey')} AS focus, 'MinInclusive' AS component, '"' || p_size || '"^^<http://www.w3.org/2001/XMLSchema#integer>' AS value FROM part WHERE p_size < 5
    UNION ALL SELECT {key('part', 'p_partkey')}, 'MaxExclusive', '"' || p_size || '"^^<http://www.w3.org/2001/XMLSchema#integer>' FROM part WHERE p_size >= 45
    UNION ALL SELECT {key('part', 'p_partkey')}, 'Datatype', '"' || p_size || '"^^<http://www.w3.org/2001/XMLSchema#integer>' FROM part""")
def shape_range_datatype(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "part", ["p_size"])
    return violations(spark, facts, "x:S a sh:NodeShape; sh:targetSubjectsOf t:p_size; sh:property [ sh:path t:p_size; sh:minInclusive 5; sh:maxExclusive 45; sh:datatype xsd:string ].")


@query(f"""SELECT {key('orders', 'o_orderkey')} AS focus, 'Class' AS component, {key('region', 'n_regionkey')} AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1 GROUP BY ALL""")
def shape_class_sequence_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.several(spark, sf_dir, {"orders": ["o_custkey"], "customer": ["c_nationkey"], "nation": ["n_regionkey"]})
    typed = spark.createDataFrame([(0, "<urn:t:region/1>", TYPE, "<urn:x:Served>")], "msg_id long, s string, p string, o string")
    return violations(spark, facts.unionByName(typed), "x:S a sh:NodeShape; sh:targetSubjectsOf t:o_custkey; sh:property [ sh:path (t:o_custkey t:c_nationkey t:n_regionkey); sh:class x:Served ].")


@query(f"""SELECT {key('customer', 'c_custkey')} AS s, '<urn:t:c_name>' AS p, {text('c_name')} AS o FROM customer""")
def closed_shape_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "customer")
    graph = shape_plan.compile_shapes(parse_triples(HEAD + "x:S a sh:NodeShape; sh:closed true; sh:targetSubjectsOf t:c_name; sh:property [ sh:path t:c_name ]."))
    return shape_plan.prune_input(facts, graph)[0].select("s", "p", "o")


@query("""WITH m AS (SELECT user_id, bool_or(event_type = 'purchase') AS strict FROM events GROUP BY user_id)
    SELECT e.user_id AS msg_id, '<urn:t:events/' || event_id || '>' AS s, '<urn:t:event_type>' AS p, '"' || event_type || '"^^<http://www.w3.org/2001/XMLSchema#string>' AS o FROM events e
    UNION ALL SELECT e.user_id, '<urn:t:events/' || event_id || '>', '<urn:t:user_id>', '<urn:t:user/' || e.user_id || '>' FROM events e JOIN m ON m.user_id = e.user_id WHERE NOT strict""")
def shape_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages (users) with a purchase are bound by the closed shape; the others keep all they have."""
    facts = R.statements(spark, sf_dir, "events", msg=F.col("user_id"))
    marks = facts.where((F.col("p") == R.predicate("event_type")) & (lexical_form(F.col("o")) == "purchase")).select("msg_id", F.col("o").alias("s"), F.lit(iri_of("mark")).alias("p"), F.col("s").alias("o"))
    graph = shape_plan.compile_shapes(parse_triples(HEAD + "x:Closed a sh:NodeShape; sh:closed true; sh:targetSubjectsOf x:mark; sh:ignoredProperties (t:event_type). x:Open a sh:NodeShape; sh:targetSubjectsOf t:user_id."))
    return shape_plan.prune_input(facts.unionByName(marks), graph)[0].where(F.col("p") != iri_of("mark")).select("msg_id", "s", "p", "o")


@query(f"""SELECT {key('customer', 'c_custkey')} AS s, '<urn:t:c_nationkey>' AS p, {key('nation', 'c_nationkey')} AS o FROM customer
    UNION ALL SELECT {key('customer', 'c_custkey')}, '<urn:t:c_mktsegment>', {text('c_mktsegment')} FROM customer WHERE c_mktsegment = 'BUILDING'""")
def output_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "customer")
    graph = shape_plan.compile_shapes(parse_triples(HEAD + 'x:S a sh:NodeShape; sh:targetSubjectsOf t:c_name; sh:property [ sh:path t:c_nationkey ], [ sh:path t:c_mktsegment; sh:hasValue "BUILDING" ].'))
    return shape_plan.project_output(facts, graph).select("s", "p", "o")


@query(f"""SELECT DISTINCT {key('customer', 'c_custkey')} AS s, '<urn:t:c_name>' AS p, {text('c_name')} AS o FROM customer
    UNION SELECT {key('customer', 'c_custkey')}, '<urn:t:c_nationkey>', {key('nation', 'c_nationkey')} FROM customer
    UNION SELECT {key('nation', 'n_nationkey')}, '<urn:t:n_name>', {text('n_name')} FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def consumer_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.several(spark, sf_dir, {"customer": ["c_name", "c_nationkey", "c_mktsegment"], "nation": ["n_name", "n_regionkey"]})
    shapes = "x:C a sh:NodeShape; sh:targetSubjectsOf t:c_nationkey; sh:property [ sh:path t:c_name ], [ sh:path t:c_nationkey; sh:node x:N ]. x:N a sh:NodeShape; sh:property [ sh:path t:n_name ]."
    return consumer.project(facts, consumer.compile_projection(parse_triples(HEAD + shapes))).select("s", "p", "o")


# --- rules, terms, messages -----------------------------------------------------------------------------------------


@query("""SELECT n_nationkey, '<urn:quadloom:genid:' || sha256(CAST(length(k) AS VARCHAR) || ':' || k || CAST(length(r) AS VARCHAR) || ':' || r) || '>' AS id
    FROM (SELECT n_nationkey, '<urn:t:nation/' || n_nationkey || '>' AS k, '<urn:t:region/' || n_regionkey || '>' AS r FROM nation)""")
def skolem_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select("n_nationkey", skolem_iri("urn:quadloom:genid:", [R.iri("nation", F.col("n_nationkey")), R.iri("region", F.col("n_regionkey"))]).alias("id"))


@query("""SELECT a.user_id AS msg_id, '<urn:t:events/' || a.event_id || '>' AS s, '<urn:t:events/' || b.event_id || '>' AS o
    FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'error'""")
def message_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join that would pair everything, were it not within messages."""
    facts = R.statements(spark, sf_dir, "events", ["event_type"], msg=F.col("user_id"))
    rules = '{ ?a t:event_type "signup". ?b t:event_type "error" } => { ?a x:with ?b }.'
    out = Engine(spark).load("", [Profile(HEAD + rules)]).infer(facts)
    return out.select("msg_id", "s", "o")


@query("""WITH f AS (SELECT min(event_id) AS t, user_id FROM events GROUP BY user_id) SELECT t, '<urn:t:user/' || user_id || '>' AS s, '<urn:x:Known>' AS o FROM f""")
def stateful_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message adds what is new against all earlier ones: a user becomes known once, at their first event."""
    facts = R.statements(spark, sf_dir, "events", ["user_id"], msg=F.col("event_id"))
    engine = Engine(spark).load(HEAD + "t:user_id rdfs:range x:Known.", ["owl2rl"])
    timed = facts.select("s", "p", "o", F.col("msg_id").alias("t"))
    known = timed_fixpoint(timed, engine.compile({(R.predicate("user_id"), None)}))
    return known.where(F.col("o") == iri_of("Known")).select("t", "s", "o")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '"' || p_size || '.0"^^<http://www.w3.org/2001/XMLSchema#decimal>' WHEN 1 THEN '"' || p_size || '"^^<http://www.w3.org/2001/XMLSchema#integer>' ELSE '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>' END AS canonical,
    CASE p_partkey % 3 WHEN 2 THEN 'btrue' ELSE 'n' || p_size END AS value FROM part""")
def literal_canonical_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"+007.50" and "7.5" and so on: one canonical form and one value."""
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    term = F.when(k == 0, make_literal(F.concat(F.lit("+00"), n, F.lit(".00")), XSD.decimal)).when(k == 1, make_literal(F.concat(F.lit("0"), n), XSD.integer)).otherwise(make_literal(F.lit("1"), XSD.boolean))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", canonical(term).alias("canonical"), value_key(term).alias("value"))


@query(f"""SELECT {key('customer', 'c_custkey')} AS s FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def not_includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.several(spark, sf_dir, {"customer": ["c_name"], "orders": ["o_custkey", "o_orderstatus"]})
    rules = '{ ?c t:c_name ?n. 1 log:notIncludes { ?o t:o_custkey ?c. ?o t:o_orderstatus "P" } } => { ?c a x:Settled }.'
    return Engine(spark).load("", [Profile(HEAD + rules)]).infer(facts).select("s")


@query(f"""SELECT {key('part', 'p_partkey')} AS s, '"' || (p_size * 2 + 1) || '"^^<http://www.w3.org/2001/XMLSchema#integer>' AS o FROM part WHERE p_size * 2 + 1 > 50""")
def arithmetic_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "part", ["p_size"])
    rules = "{ ?p t:p_size ?n. (?n 2) math:product ?d. (?d 1) math:sum ?r. ?r math:greaterThan 50 } => { ?p x:score ?r }."
    return Engine(spark).load("", [Profile(HEAD + rules)]).infer(facts).select("s", "o")


@query(f"""SELECT {key('part', 'p_partkey')} AS s, '"' || (p_size * 2 + 1) || '"^^<http://www.w3.org/2001/XMLSchema#integer>' AS o FROM part WHERE p_size * 2 + 1 > 50""")
def arithmetic_rule_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule as generated SQL."""
    facts = R.statements(spark, sf_dir, "part", ["p_size"])
    rules = "{ ?p t:p_size ?n. (?n 2) math:product ?d. (?d 1) math:sum ?r. ?r math:greaterThan 50 } => { ?p x:score ?r }."
    program = sql.translate(HEAD + rules).program
    return sql.execute(spark, program, facts, max_facts=10**12)["derived"].select("s", "o")


@query(f"""SELECT {key('supplier', 's_suppkey')} AS s, CAST(length(s_name) AS BIGINT) AS n FROM supplier WHERE contains(s_name, '7')""")
def string_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "supplier", ["s_name"])
    rules = '{ ?s t:s_name ?n. ?n string:contains "7". ?n string:length ?l } => { ?s x:length ?l }.'
    out = Engine(spark).load("", [Profile(HEAD + rules)]).infer(facts)
    return out.select("s", lexical_form(F.col("o")).cast("long").alias("n"))


@query(f"""SELECT {key('region', 'r_regionkey')} AS s, '<urn:t:r_name>' AS p, {text('r_name')} AS o FROM region""")
def nquads_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.statements(spark, sf_dir, "region", ["r_name"]).select(nquads.line_of().alias("value"))
    return nquads.parse_lines(lines).select("s", "p", "o")


@query(f"""SELECT DISTINCT {key('customer', 'c_custkey')} AS s, '<urn:t:c_nationkey>' AS p, {key('nation', 'c_nationkey')} AS o FROM customer
    UNION SELECT {key('supplier', 's_suppkey')}, '<urn:t:s_nationkey>', {key('nation', 's_nationkey')} FROM supplier""")
def union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.several(spark, sf_dir, {"customer": ["c_nationkey"], "supplier": ["s_nationkey"]})
    return emit.unique(facts.unionByName(facts)).select("s", "p", "o")


@query(f"""SELECT {key('part', 'p_partkey')} AS s, 'http://www.w3.org/2001/XMLSchema#integer' AS datatype, CAST(p_size AS VARCHAR) AS lexical FROM part""")
def literal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = R.statements(spark, sf_dir, "part", ["p_size"])
    return facts.select("s", F.regexp_extract(datatype_of(F.col("o")), "<(.*)>", 1).alias("datatype"), lexical_form(F.col("o")).alias("lexical"))
