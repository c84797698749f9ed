"""More registered queries: families of rules that the first module has no query for, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.engine import Engine, Profile
from quadloom.plans import relational as R
from quadloom.queries import HEAD, STR, T, contradictions_in, derive, iri_of, key, query, text
from quadloom.terms import lexical_form
from quadloom.vocab import OWL, PREFIXES, SAME_AS, TYPE

SKOS = f"<{PREFIXES['skos']}"


def link(spark: SparkSession, sf_dir: str, table: str, subject, predicate: str, obj) -> DataFrame:
    """One statement a row of a table."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.select(F.lit(0).cast("long").alias("msg_id"), subject.alias("s"), F.lit(predicate).alias("p"), obj.alias("o")).where("s is not null and o is not null")


def minted(name: str, column: str):
    return F.concat(F.lit(f"<urn:x:{name}/"), F.col(column).cast("string"), F.lit(">"))


def customer_iri():
    return R.iri("customer", F.col("c_custkey"))


def nation_iri(column: str = "n_nationkey"):
    return R.iri("nation", F.col(column))


# --- equality and difference ----------------------------------------------------------------------------------------


@query(f"""WITH a AS (SELECT {key('nation', 'n_nationkey')} AS n, '<urn:x:country/' || n_nationkey || '>' AS c, n_name FROM nation)
    SELECT c AS s, '{SAME_AS}' AS p, n AS o FROM a UNION SELECT c, '<urn:t:n_name>', {text('n_name')} FROM a
    UNION SELECT {key('customer', 'c_custkey')}, '<urn:t:c_nationkey>', '<urn:x:country/' || c_nationkey || '>' FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def equality_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sameAs of the data is symmetric and substitutes subjects and objects."""
    facts = R.several(spark, sf_dir, {"nation": ["n_name"], "customer": ["c_nationkey"]})
    same = link(spark, sf_dir, "nation", nation_iri(), SAME_AS, minted("country", "n_nationkey"))
    return derive(spark, facts.unionByName(same), "")


@query(f"""SELECT DISTINCT {key('customer', 'c_custkey')} AS s, '<urn:x:home>' AS p, {key('nation', 'c_nationkey')} AS o FROM customer""")
def predicate_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sameAs of the ontology substitutes predicates."""
    return derive(spark, R.statements(spark, sf_dir, "customer", ["c_nationkey"]), "t:c_nationkey owl:sameAs x:home.")


@query(f"""SELECT DISTINCT {key('part', 'a.p_partkey')} AS s, {key('part', 'b.p_partkey')} AS o FROM part a JOIN part b
    ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey""")
def key_axiom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owl:hasKey of three properties: parts that agree in all are the same."""
    facts = R.statements(spark, sf_dir, "part", ["p_brand", "p_type", "p_size"])
    typed = link(spark, sf_dir, "part", R.iri("part", F.col("p_partkey")), TYPE, F.lit(iri_of("Part")))
    out = derive(spark, facts.unionByName(typed), "x:Part owl:hasKey (t:p_brand t:p_type t:p_size).")
    return out.where(F.col("p") == SAME_AS).select("s", "o")


@query(f"""WITH r AS (SELECT {key('nation', 'n_nationkey')} AS n, {key('region', 'n_regionkey')} AS r, {key('region', 'r_regionkey')} AS f
        FROM nation JOIN region ON r_regionkey = (n_regionkey + 1) % (SELECT count(*) FROM region)),
      d AS (SELECT a.n AS x, b.n AS y FROM r a JOIN r b ON a.r = b.f UNION SELECT a.r, a.f FROM r a)
    SELECT DISTINCT x AS s, y AS o FROM (SELECT x, y FROM d UNION SELECT y, x FROM d)""")
def disjoint_properties_tell_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that share a value of two disjoint properties differ, and so do values that share a subject."""
    facts = R.statements(spark, sf_dir, "nation", ["n_regionkey"])
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").count()
    former = link(spark, sf_dir, "nation", nation_iri(), iri_of("former"), R.iri("region", (F.col("n_regionkey") + 1) % regions))
    out = derive(spark, facts.unionByName(former), "t:n_regionkey owl:propertyDisjointWith x:former.")
    return out.where(F.col("p") == OWL.differentFrom).select("s", "o")


@query(f"""WITH c AS (SELECT {key('nation', 'a.n_nationkey')} AS x, {key('nation', 'b.n_nationkey')} AS y, {key('region', 'a.n_regionkey')} AS r, {key('region', 'b.n_regionkey')} AS q FROM nation a JOIN nation b ON a.n_regionkey <> b.n_regionkey)
    SELECT DISTINCT x AS s, y AS o FROM c""")
def functional_values_tell_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose regions differ are different, for a nation has one region."""
    facts = R.statements(spark, sf_dir, "nation", ["n_regionkey"])
    regions = [f"<urn:t:region/{r.r_regionkey}>" for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect()]
    apart = spark.createDataFrame([(0, a, OWL.differentFrom, b) for a in regions for b in regions if a != b], "msg_id long, s string, p string, o string")
    out = derive(spark, facts.unionByName(apart), "t:n_regionkey a owl:FunctionalProperty.")
    return out.where((F.col("p") == OWL.differentFrom) & F.col("s").startswith("<urn:t:nation/")).select("s", "o")


@query(f"""WITH c AS (SELECT {key('customer', 'c_custkey')} AS x, {key('nation', 'c_nationkey')} AS a, '<urn:x:country/' || c_nationkey || '>' AS b FROM customer)
    SELECT DISTINCT a AS s, b AS o FROM c UNION SELECT DISTINCT b, a FROM c""")
def at_most_one_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer has one home at most, so the two that are named are the same; once by class, once by all values."""
    homes = link(spark, sf_dir, "customer", customer_iri(), iri_of("home"), nation_iri("c_nationkey")).unionByName(link(spark, sf_dir, "customer", customer_iri(), iri_of("home"), minted("country", "c_nationkey")))
    ontology = """x:home rdfs:domain x:Customer; rdfs:range x:Place. x:Customer rdfs:subClassOf x:One, x:OnePlace, x:OneThing.
        x:One owl:onProperty x:home; owl:maxCardinality 1 . x:OnePlace owl:onProperty x:home; owl:maxQualifiedCardinality 1; owl:onClass x:Place.
        x:OneThing owl:onProperty x:home; owl:maxQualifiedCardinality 1; owl:onClass owl:Thing."""
    return derive(spark, homes, ontology).where((F.col("p") == SAME_AS) & ~F.col("s").startswith("<urn:t:customer/")).select("s", "o")


# --- properties and classes -----------------------------------------------------------------------------------------


@query(f"""WITH h AS (SELECT {key('customer', 'c_custkey')} AS c, {key('nation', 'c_nationkey')} AS n FROM customer)
    SELECT DISTINCT s, p, o FROM (
      SELECT c AS s, '<urn:x:livesIn>' AS p, n AS o FROM h UNION ALL SELECT c, '<urn:x:knows>', n FROM h UNION ALL SELECT n, '<urn:x:hosts>', c FROM h
      UNION ALL SELECT c, '{T}', '<urn:x:Person>' FROM h UNION ALL SELECT c, '{T}', '<urn:x:Agent>' FROM h
      UNION ALL SELECT n, '{T}', '<urn:x:Place>' FROM h UNION ALL SELECT n, '{T}', '<urn:x:Area>' FROM h)""")
def inherited_domains_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains and ranges go down the property hierarchy and up the class hierarchy; equivalences are both ways."""
    facts = R.statements(spark, sf_dir, "customer", ["c_nationkey"])
    ontology = """t:c_nationkey rdfs:subPropertyOf x:livesIn. x:livesIn rdfs:subPropertyOf x:knows; owl:inverseOf x:hosts; rdfs:domain x:Person; rdfs:range x:Place.
        x:Person owl:equivalentClass x:Agent. x:Place rdfs:subClassOf x:Area."""
    return derive(spark, facts, ontology)


@query(f"""WITH RECURSIVE e AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
    g AS (SELECT a, b FROM e WHERE b IS NOT NULL), r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b)
    SELECT '<urn:t:events/' || a || '>' AS s, '<urn:t:events/' || b || '>' AS o FROM r EXCEPT SELECT '<urn:t:events/' || a || '>', '<urn:t:events/' || b || '>' FROM g""")
def chain_of_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property whose chain with itself is the property is transitive."""
    from quadloom.queries import successors

    return derive(spark, successors(spark, sf_dir), "x:before owl:propertyChainAxiom (x:before x:before).").select("s", "o")


@query(f"""WITH j AS (SELECT {key('lineitem', 'l_orderkey')} AS l, o_orderkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT DISTINCT l AS s, p, o FROM (
      SELECT l, '<urn:x:soldTo>' AS p, {key('region', 'n_regionkey')} AS o FROM j JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
      UNION ALL SELECT l, '<urn:x:sold>', {key('orders', 'o_orderkey')} FROM j)""")
def property_chain_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of one and of four properties."""
    facts = R.several(spark, sf_dir, {"orders": ["o_custkey"], "customer": ["c_nationkey"], "nation": ["n_regionkey"]})
    lines = link(spark, sf_dir, "lineitem", R.iri("lineitem", F.col("l_orderkey")), iri_of("of"), R.iri("orders", F.col("l_orderkey"))).distinct()
    ontology = "x:soldTo owl:propertyChainAxiom (x:of t:o_custkey t:c_nationkey t:n_regionkey). x:sold owl:propertyChainAxiom (x:of)."
    return derive(spark, facts.unionByName(lines), ontology)


@query(f"""SELECT DISTINCT s, p, o FROM (
      SELECT {key('customer', 'c_custkey')} AS s, '<urn:x:sector>' AS p, '"BUILDING"{STR}' AS o FROM customer WHERE c_mktsegment = 'BUILDING'
      UNION ALL SELECT {key('customer', 'c_custkey')}, '{T}', '<urn:x:Builder>' FROM customer WHERE c_mktsegment = 'BUILDING'
      UNION ALL SELECT {key('customer', 'c_custkey')}, '{T}', '<urn:x:InSector>' FROM customer WHERE c_mktsegment = 'BUILDING'
      UNION ALL SELECT {key('customer', 'c_custkey')}, '{T}', '<urn:x:Resident>' FROM customer
      UNION ALL SELECT {key('region', 'r_regionkey')}, '<urn:x:self>', {key('region', 'r_regionkey')} FROM region
      UNION ALL SELECT '<urn:t:nation/' || k || '>', '{T}', '<urn:x:Chosen>' FROM (VALUES (1), (2), (3)) v(k))""")
def restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hasValue gives values and classes, someValuesFrom owl:Thing, enumerations, reflexive properties of named individuals."""
    facts = R.statements(spark, sf_dir, "customer", ["c_nationkey"])
    segments = link(spark, sf_dir, "customer", customer_iri(), TYPE, F.concat(F.lit("<urn:x:"), "c_mktsegment", F.lit(">")))
    named = link(spark, sf_dir, "region", R.iri("region", F.col("r_regionkey")), TYPE, F.lit(OWL.NamedIndividual))
    ontology = """x:BUILDING rdfs:subClassOf x:Builder. x:Builder owl:onProperty x:sector; owl:hasValue "BUILDING".
        x:InSector owl:onProperty x:sector; owl:someValuesFrom owl:Thing. x:Resident owl:onProperty t:c_nationkey; owl:someValuesFrom owl:Thing.
        x:Chosen owl:oneOf (<urn:t:nation/1> <urn:t:nation/2> <urn:t:nation/3>). x:self a owl:ReflexiveProperty."""
    engine = Engine(spark).load(HEAD + ontology, ["owl2rl"])
    members = spark.createDataFrame([(0, s, p, o) for s, p, o in engine.static_closure if o == iri_of("Chosen") and p == TYPE], "msg_id long, s string, p string, o string")
    wanted = F.col("p").isin(iri_of("sector"), iri_of("self")) | F.col("o").isin(*(iri_of(x) for x in ("Builder", "InSector", "Resident", "Chosen")))
    return engine.infer(facts.unionByName(segments).unionByName(named)).unionByName(members).where(wanted).select("s", "p", "o").distinct()


# --- contradictions -------------------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT {key('customer', 'c_custkey')} AS c, {key('nation', 'c_nationkey')} AS n, c_mktsegment AS m, c_nationkey AS k FROM customer)
    SELECT DISTINCT rule, terms FROM (
      SELECT 'cls-com' AS rule, '<urn:x:BUILDING> <urn:x:Afloat> ' || c AS terms FROM c WHERE m IN ('BUILDING', 'FURNITURE') AND k = 7
      UNION ALL SELECT 'cls-nothing2', c FROM c WHERE m = 'MACHINERY'
      UNION ALL SELECT 'cax-adc', '<urn:x:apart> <urn:x:FURNITURE> <urn:x:Afloat> ' || c FROM c WHERE m = 'FURNITURE' AND k = 7
      UNION ALL SELECT 'cax-dw', '<urn:x:FURNITURE> <urn:x:Afloat> ' || c FROM c WHERE m = 'FURNITURE' AND k = 7
      UNION ALL SELECT 'prp-pdw', '<urn:t:c_nationkey> <urn:x:avoids> ' || c || ' ' || n FROM c)""")
def contradictions_of_classes_and_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complements, empty classes, pairwise disjoint classes, disjoint properties."""
    facts = R.statements(spark, sf_dir, "customer", ["c_nationkey"])
    facts = facts.unionByName(link(spark, sf_dir, "customer", customer_iri(), TYPE, F.concat(F.lit("<urn:x:"), "c_mktsegment", F.lit(">"))))
    facts = facts.unionByName(link(spark, sf_dir, "customer", customer_iri(), iri_of("avoids"), nation_iri("c_nationkey")))
    ontology = """[ owl:onProperty t:c_nationkey; owl:hasValue <urn:t:nation/7> ] rdfs:subClassOf x:Afloat. x:BUILDING owl:complementOf x:Afloat. x:MACHINERY rdfs:subClassOf owl:Nothing.
        x:apart a owl:AllDisjointClasses; owl:members (x:FURNITURE x:Afloat). t:c_nationkey owl:propertyDisjointWith x:avoids."""
    return contradictions_in(spark, facts, ontology).distinct()


@query(f"""WITH c AS (SELECT {key('customer', 'c_custkey')} AS c, {key('nation', 'c_nationkey')} AS n FROM customer WHERE c_mktsegment = 'HOUSEHOLD')
    SELECT 'cls-maxqc1' AS rule, '<urn:x:NoPlace> ' || c || ' <urn:t:c_nationkey> ' || n || ' <urn:x:Place>' AS terms FROM c
    UNION ALL SELECT 'cls-maxqc2', '<urn:x:NoThing> ' || c || ' <urn:t:c_nationkey> ' || n FROM c""")
def qualified_cardinality_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a class, and values at all, where there may be none."""
    facts = R.statements(spark, sf_dir, "customer", ["c_nationkey"]).unionByName(link(spark, sf_dir, "customer", customer_iri(), TYPE, F.concat(F.lit("<urn:x:"), "c_mktsegment", F.lit(">"))))
    ontology = """t:c_nationkey rdfs:range x:Place. x:HOUSEHOLD rdfs:subClassOf x:NoPlace, x:NoThing. x:NoPlace owl:onProperty t:c_nationkey; owl:maxQualifiedCardinality 0; owl:onClass x:Place.
        x:NoThing owl:onProperty t:c_nationkey; owl:maxQualifiedCardinality 0; owl:onClass owl:Thing."""
    return contradictions_in(spark, facts, ontology).distinct()


@query(f"""SELECT 'prp-adp' AS rule, '<urn:x:apart> <urn:t:n_regionkey> <urn:x:borders> ' || {key('nation', 'n_nationkey')} || ' ' || {key('region', 'n_regionkey')} AS terms FROM nation
    UNION SELECT 'prp-pdw', '<urn:t:n_regionkey> <urn:x:borders> ' || {key('nation', 'n_nationkey')} || ' ' || {key('region', 'n_regionkey')} FROM nation""")
def contradictions_of_disjoint_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AllDisjointProperties, and what it says of each pair."""
    facts = R.statements(spark, sf_dir, "nation", ["n_regionkey"])
    borders = link(spark, sf_dir, "nation", nation_iri(), iri_of("borders"), R.iri("region", F.col("n_regionkey")))
    ontology = "x:apart a owl:AllDisjointProperties; owl:members (t:n_regionkey x:borders)."
    return contradictions_in(spark, facts.unionByName(borders), ontology).distinct()


@query(f"""WITH z AS (SELECT {key('region', 'r_regionkey')} AS a, '<urn:x:zone/' || r_regionkey || '>' AS b FROM region)
    SELECT 'eq-diff1' AS rule, a || ' ' || b AS terms FROM z
    UNION ALL SELECT l.rule, l.list || ' ' || a || ' ' || b FROM z, (VALUES ('eq-diff2', '<urn:x:differ>'), ('eq-diff3', '<urn:x:distinct>')) l(rule, list) WHERE a = '<urn:t:region/1>'
    UNION ALL SELECT l.rule, l.list || ' ' || b || ' ' || a FROM z, (VALUES ('eq-diff2', '<urn:x:differ>'), ('eq-diff3', '<urn:x:distinct>')) l(rule, list) WHERE a = '<urn:t:region/1>'""")
def same_and_different(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sameAs against differentFrom, as it is asserted and by both forms of AllDifferent."""
    zone, region = minted("zone", "r_regionkey"), R.iri("region", F.col("r_regionkey"))
    facts = link(spark, sf_dir, "region", region, SAME_AS, zone).unionByName(link(spark, sf_dir, "region", region, OWL.differentFrom, zone))
    ontology = """x:differ a owl:AllDifferent; owl:members (<urn:t:region/1> <urn:x:zone/1>). x:distinct a owl:AllDifferent; owl:distinctMembers (<urn:t:region/1> <urn:x:zone/1>)."""
    found = contradictions_in(spark, facts, ontology).distinct()
    # Substitution also finds each of the two for itself and the other way round.
    asserted = F.col("terms").startswith("<urn:t:region/") & F.col("terms").contains(" <urn:x:zone/")
    return found.where((F.col("rule") != "eq-diff1") | asserted)


# --- thesaurus ------------------------------------------------------------------------------------------------------


@query(f"""SELECT DISTINCT s, p, o FROM (
      SELECT '<urn:x:scheme>' AS s, '{SKOS}hasTopConcept>' AS p, {key('region', 'r_regionkey')} AS o FROM region
      UNION ALL SELECT {key('region', 'r_regionkey')}, '{SKOS}inScheme>', '<urn:x:scheme>' FROM region
      UNION ALL SELECT {key('region', 'r_regionkey')}, '{T}', '{SKOS}Concept>' FROM region UNION ALL SELECT '<urn:x:scheme>', '{T}', '{SKOS}ConceptScheme>' FROM region
      UNION ALL SELECT {key('region', 'r_regionkey')}, '{SKOS}note>', {text('r_name')} FROM region
      UNION ALL SELECT {key('nation', 'n_nationkey')}, '{SKOS}note>', {text('n_name')} FROM nation
      UNION ALL SELECT {key('nation', 'n_nationkey')}, '<http://www.w3.org/2000/01/rdf-schema#label>', {text('n_name')} FROM nation)""")
def skos_schemes_and_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = R.statements(spark, sf_dir, "nation", ["n_name"])
    facts = link(spark, sf_dir, "region", R.iri("region", F.col("r_regionkey")), f"{SKOS}topConceptOf>", F.lit("<urn:x:scheme>"))
    facts = facts.unionByName(R.statements(spark, sf_dir, "region", ["r_name"]).withColumn("p", F.lit(f"{SKOS}scopeNote>")))
    for p in ("definition", "changeNote", "editorialNote", "example", "historyNote", "altLabel", "hiddenLabel"):
        facts = facts.unionByName(names.withColumn("p", F.lit(f"{SKOS}{p}>")))
    return derive(spark, facts, "", profiles=["skos"])


@query(f"""WITH e AS (SELECT {key('supplier', 's_suppkey')} AS a, {key('nation', 's_nationkey')} AS b FROM supplier),
      x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), t AS (SELECT a, b FROM x UNION SELECT p.a, q.b FROM x p JOIN x q ON p.b = q.a),
      m AS (SELECT a, b FROM t UNION SELECT p.a, q.b FROM t p JOIN t q ON p.b = q.a),
      r AS (SELECT {key('nation', 'n_nationkey')} AS a, {key('region', 'n_regionkey')} AS b FROM nation)
    SELECT a AS s, '{SKOS}exactMatch>' AS p, b AS o FROM (SELECT * FROM m EXCEPT SELECT * FROM e) UNION SELECT a, '{SKOS}closeMatch>', b FROM m
    UNION SELECT a, '{SKOS}narrowMatch>', b FROM (SELECT b AS a, a AS b FROM r) UNION SELECT a, '{SKOS}broader>', b FROM r UNION SELECT b, '{SKOS}narrower>', a FROM r
    UNION SELECT a, '{SKOS}related>', b FROM (SELECT a, b FROM r UNION SELECT b, a FROM r) UNION SELECT b, '{SKOS}relatedMatch>', a FROM r""")
def skos_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exactMatch is symmetric, transitive and a closeMatch; broadMatch is broader and the inverse of narrowMatch; relatedMatch is symmetric and related."""
    facts = R.statements(spark, sf_dir, "supplier", ["s_nationkey"]).withColumn("p", F.lit(f"{SKOS}exactMatch>"))
    regions = R.statements(spark, sf_dir, "nation", ["n_regionkey"])
    for p in ("broadMatch", "relatedMatch"):
        facts = facts.unionByName(regions.withColumn("p", F.lit(f"{SKOS}{p}>")))
    wanted = [f"{SKOS}{p}>" for p in ("exactMatch", "closeMatch", "narrowMatch", "broader", "narrower", "related", "relatedMatch")]
    return derive(spark, facts, "", profiles=["skos"], predicates=wanted)


@query(f"""SELECT DISTINCT s, p, o FROM (
      SELECT '<urn:x:nations>' AS s, '{T}' AS p, c AS o FROM (VALUES ('{SKOS}OrderedCollection>'), ('{SKOS}Collection>')) v(c)
      UNION ALL SELECT '<urn:x:nations>', '{SKOS}member>', {key('nation', 'n_nationkey')} FROM nation
      UNION ALL SELECT '<urn:x:regions>', '{T}', '{SKOS}Collection>' FROM region)""")
def skos_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of an ordered collection, which is data, gives its members."""
    first, rest = f"<{PREFIXES['rdf']}first>", f"<{PREFIXES['rdf']}rest>"
    nil = f"<{PREFIXES['rdf']}nil>"
    from pyspark.sql import Window

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("next", F.lead("n_nationkey").over(Window.orderBy("n_nationkey"))).withColumn("first", F.first("n_nationkey").over(Window.orderBy("n_nationkey")))
    cell = lambda c: F.concat(F.lit("<urn:x:cell/"), F.col(c).cast("string"), F.lit(">"))
    row = lambda s, p, o: nation.select(F.lit(0).cast("long").alias("msg_id"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    facts = row(cell("n_nationkey"), first, nation_iri()).unionByName(row(cell("n_nationkey"), rest, F.coalesce(cell("next"), F.lit(nil))))
    facts = facts.unionByName(row(F.lit("<urn:x:nations>"), f"{SKOS}memberList>", cell("first")).distinct())
    facts = facts.unionByName(link(spark, sf_dir, "region", F.lit("<urn:x:regions>"), f"{SKOS}member>", R.iri("region", F.col("r_regionkey"))))
    return derive(spark, facts, "", profiles=["skos"]).where(F.col("s").isin("<urn:x:nations>", "<urn:x:regions>"))


# --- builtins -------------------------------------------------------------------------------------------------------


def by_rule(spark: SparkSession, facts: DataFrame, rules: str) -> DataFrame:
    return Engine(spark).load("", [Profile(HEAD + rules)]).infer(facts).select("s", "p", "o")


@query(f"""SELECT {key('part', 'p_partkey')} AS s, '<urn:x:' || k || '>' AS p, v AS o FROM (
      SELECT p_partkey, 'below' AS k, p_size - 50 AS v FROM part UNION ALL SELECT p_partkey, 'negative', -p_size FROM part UNION ALL SELECT p_partkey, 'distance', abs(p_size - 50) FROM part
      UNION ALL SELECT p_partkey, 'half', CAST(floor(p_size / CAST(2 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) FROM part
      UNION ALL SELECT p_partkey, 'down', CAST(floor(p_size / CAST(4 AS DOUBLE)) AS BIGINT) FROM part UNION ALL SELECT p_partkey, 'up', CAST(ceil(p_size / CAST(4 AS DOUBLE)) AS BIGINT) FROM part
      UNION ALL SELECT p_partkey, 'square', p_size * p_size FROM part UNION ALL SELECT p_partkey, 'twelfths', CAST(round(ln(p_size) / ln(2) * 12) AS BIGINT) FROM part)""")
def number_builtins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """difference, negation, absoluteValue, quotient with rounded, floor, ceiling, exponentiation and its exponent; values as integers."""
    rules = """{ ?p t:p_size ?n. (?n 50) math:difference ?d } => { ?p x:below ?d }. { ?p t:p_size ?n. ?n math:negation ?d } => { ?p x:negative ?d }.
        { ?p t:p_size ?n. (?n 50) math:difference ?e. ?e math:absoluteValue ?d } => { ?p x:distance ?d }. { ?p t:p_size ?n. (?n 2) math:quotient ?e. ?e math:rounded ?d } => { ?p x:half ?d }.
        { ?p t:p_size ?n. (?n 4) math:quotient ?e. ?e math:floor ?d } => { ?p x:down ?d }. { ?p t:p_size ?n. (?n 4) math:quotient ?e. ?e math:ceiling ?d } => { ?p x:up ?d }.
        { ?p t:p_size ?n. (?n 2) math:exponentiation ?d } => { ?p x:square ?d }. { ?p t:p_size ?n. (?n 0) math:quotient ?d } => { ?p x:never ?d }.
        { ?p t:p_size ?n. (2 ?e) math:exponentiation ?n. (?e 12) math:product ?d } => { ?p x:twelfths ?d }."""
    out = by_rule(spark, R.statements(spark, sf_dir, "part", ["p_size"]), rules)
    return out.select("s", "p", F.round(lexical_form(F.col("o")).cast("double")).cast("long").alias("o"))


@query(f"""SELECT {key('part', 'p_partkey')} AS s, '<urn:x:' || k || '>' AS p FROM (
      SELECT p_partkey, 'less' AS k FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, 'most' FROM part WHERE p_size <= 10 UNION ALL SELECT p_partkey, 'least' FROM part WHERE p_size >= 10
      UNION ALL SELECT p_partkey, 'equal' FROM part WHERE p_size = 10 UNION ALL SELECT p_partkey, 'other' FROM part WHERE p_size <> 10 UNION ALL SELECT p_partkey, 'ten' FROM part WHERE p_size = 10
      UNION ALL SELECT p_partkey, 'integer' FROM part UNION ALL SELECT p_partkey, 'same' FROM part WHERE p_size = 10 UNION ALL SELECT p_partkey, 'differs' FROM part WHERE p_size <> 10 UNION ALL SELECT p_partkey, 'unlisted' FROM part WHERE p_size NOT IN (10, 11))""")
def comparison_builtins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons of numbers, identity and value of terms, validity for a datatype, membership of a list."""
    tests = {"less": "?n math:lessThan 10", "most": "?n math:notGreaterThan 10", "least": "?n math:notLessThan 10", "equal": "?n math:equalTo 10.0", "other": "?n math:notEqualTo 10", "ten": "?n log:equalTo 10",
             "integer": "?n dt:validForDatatype xsd:integer", "never": "?n dt:invalidForDatatype xsd:integer", "same": '?n dt:sameValueAs "10.00"^^xsd:decimal', "differs": '?n dt:differentValueFrom "10.00"^^xsd:decimal', "unlisted": "(10 11) list:notMember ?n"}
    rules = " ".join(f"{{ ?p t:p_size ?n. {test} }} => {{ ?p x:{name} ?n }}." for name, test in tests.items())
    return by_rule(spark, R.statements(spark, sf_dir, "part", ["p_size"]), rules).select("s", "p")


@query(f"""SELECT {key('supplier', 's_suppkey')} AS s, '<urn:x:' || k || '>' AS p, '"' || v || '"{STR}' AS o FROM (
      SELECT s_suppkey, 'greeting' AS k, 'Dear ' || s_name AS v FROM supplier UNION ALL SELECT s_suppkey, 'number', regexp_extract(s_name, '#0*([0-9]+)', 1) FROM supplier WHERE regexp_matches(s_name, '#0*([0-9]+)')
      UNION ALL SELECT s_suppkey, 'starts', s_name FROM supplier WHERE starts_with(s_name, 'Supp') UNION ALL SELECT s_suppkey, 'ends', s_name FROM supplier WHERE ends_with(s_name, '1')
      UNION ALL SELECT s_suppkey, 'matches', s_name FROM supplier WHERE regexp_matches(s_name, '[13]+$') UNION ALL SELECT s_suppkey, 'plain', s_name FROM supplier WHERE NOT regexp_matches(s_name, '[13]+$')
      UNION ALL SELECT s_suppkey, 'form', s_name FROM supplier)
    UNION ALL SELECT {key('supplier', 's_suppkey')}, '<urn:x:typed>', '"' || s_name || '"^^<urn:x:code>' FROM supplier
    UNION ALL SELECT {key('supplier', 's_suppkey')}, '<urn:x:kind>', '<http://www.w3.org/2001/XMLSchema#string>' FROM supplier""")
def text_builtins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """concatenation, scrape, startsWith, endsWith, matches, notMatches, dtlit, datatype and lexical form."""
    rules = """{ ?s t:s_name ?n. ("Dear " ?n) string:concatenation ?g } => { ?s x:greeting ?g }. { ?s t:s_name ?n. (?n "#0*([0-9]+)") string:scrape ?g } => { ?s x:number ?g }.
        { ?s t:s_name ?n. ?n string:startsWith "Supp" } => { ?s x:starts ?n }. { ?s t:s_name ?n. ?n string:endsWith "1" } => { ?s x:ends ?n }.
        { ?s t:s_name ?n. ?n string:matches "[13]+$" } => { ?s x:matches ?n }. { ?s t:s_name ?n. ?n string:notMatches "[13]+$" } => { ?s x:plain ?n }.
        { ?s t:s_name ?n. ?n dt:lexicalForm ?g } => { ?s x:form ?g }. { ?s t:s_name ?n. (?n x:code) log:dtlit ?g } => { ?s x:typed ?g }. { ?s t:s_name ?n. ?n dt:datatype ?g } => { ?s x:kind ?g }."""
    return by_rule(spark, R.statements(spark, sf_dir, "supplier", ["s_name"]), rules)


@query(f"""SELECT {key('customer', 'c_custkey')} AS s, '<urn:x:busy>' AS p FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
    UNION ALL SELECT {key('customer', 'c_custkey')}, '<urn:x:idle>' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
    UNION ALL SELECT {key('customer', 'c_custkey')}, '<urn:x:near>' FROM customer WHERE c_nationkey IN (3, 7)""")
def includes_and_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log:includes and notIncludes, members of a list, and a helper of two clauses that is unfolded."""
    facts = R.several(spark, sf_dir, {"customer": ["c_name", "c_nationkey"], "orders": ["o_custkey"]})
    rules = """{ ?c t:c_name ?n. 1 log:includes { ?o t:o_custkey ?c } } => { ?c x:busy ?n }. { ?c t:c_name ?n. 1 log:notIncludes { ?o t:o_custkey ?c } } => { ?c x:idle ?n }.
        { ?c x:at ?k } <= { ?c t:c_nationkey ?k. (<urn:t:nation/3>) list:member ?k }. { ?c x:at ?k } <= { ?c t:c_nationkey ?k. (<urn:t:nation/7>) list:member ?k }.
        { ?c x:at ?k. ?c t:c_name ?n } => { ?c x:near ?n }."""
    return by_rule(spark, facts, rules).select("s", "p")
