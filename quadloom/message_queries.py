"""Registered queries of messages, stores, streams, files, reports, shapes and quantity nodes, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.engine import Engine, Profile
from quadloom.functions.datatypes import canonical
from quadloom.operators import emit, literals, quantities, shape_plan
from quadloom.operators.paths import Path, evaluate_all
from quadloom.operators.shacl import Validator, conforms, result_statements
from quadloom.plans import relational as R
from quadloom.plans import sql
from quadloom.plans.storage import stored
from quadloom.queries import HEAD, STR, T, iri_of, key, query, successors, text, violations
from quadloom.rule_queries import customer_iri, link
from quadloom.sources import nquads
from quadloom.sources.rdf import parse_triples
from quadloom.streaming.messages import FactStore, infer_with_store, stream
from quadloom.terms import is_literal, lexical_form, make_literal
from quadloom.vocab import LCDT, QUDT, SAME_AS, TYPE, UNIT, XSD

# --- messages, stores, streams ----------------------------------------------------------------------------------------


def event_types(spark: SparkSession, sf_dir: str, msg: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col(msg).cast("long").alias("msg_id"), R.iri("user", F.col("user_id")).alias("s"), F.lit(TYPE).alias("p"), F.concat(F.lit("<urn:x:"), "event_type", F.lit(">")).alias("o"))


@query(f"""WITH f AS (SELECT user_id, min(event_id) FILTER (event_type = 'click') AS c, min(event_id) FILTER (event_type = 'error') AS e FROM events GROUP BY user_id)
    SELECT greatest(c, e) AS msg_id, '<urn:t:user/' || user_id || '>' AS s, '{T}' AS p, '<urn:x:Unlucky>' AS o FROM f WHERE c IS NOT NULL AND e IS NOT NULL""")
def store_over_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that is spread over messages and batches: the class is derived once, at the message that completes it."""
    engine = Engine(spark).load(HEAD + "x:Unlucky owl:intersectionOf (x:click x:error).", ["owl2rl"])
    store = FactStore.temporary(spark, "two-batches")
    facts = event_types(spark, sf_dir, "event_id")
    middle = facts.agg(F.expr("percentile_approx(msg_id, 0.5)")).first()[0] or 0
    first, _ = infer_with_store(engine, facts.where(F.col("msg_id") <= middle), store, "1")
    second, _ = infer_with_store(engine, facts.where(F.col("msg_id") > middle), store, "2")
    return first.unionByName(second).where(F.col("o") == iri_of("Unlucky")).select("msg_id", "s", "p", "o")


@query(f"""SELECT event_id AS msg_id, '<urn:t:user/' || user_id || '>' AS s, '{T}' AS p, '<urn:x:Active>' AS o FROM events WHERE event_type IN ('purchase', 'signup')""")
def stream_of_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events, each a message of its own, derived without a store."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    facts = events.select(F.col("event_id").cast("long").alias("msg_id"), R.iri("user", F.col("user_id")).alias("s"), F.lit(TYPE).alias("p"), F.concat(F.lit("<urn:x:"), "event_type", F.lit(">")).alias("o"))
    engine = Engine(spark).load(HEAD + "x:purchase rdfs:subClassOf x:Active. x:signup rdfs:subClassOf x:Active.", ["owl2rl"])
    store = FactStore.temporary(spark, "stream-work")
    stream(engine, facts, f"{store.folder}-out", f"{store.folder}-checkpoint").awaitTermination()
    return spark.read.schema("msg_id long, s string, p string, o string").option("recursiveFileLookup", "true").parquet(f"{store.folder}-out")


@query("""SELECT CAST(o_custkey AS BIGINT) AS msg_id, string_agg('<urn:t:orders/' || o_orderkey || '> <urn:t:o_orderstatus> "' || o_orderstatus || '"^^<http://www.w3.org/2001/XMLSchema#string> .', chr(10) ORDER BY '<urn:t:orders/' || o_orderkey || '> <urn:t:o_orderstatus> "' || o_orderstatus) AS text FROM orders GROUP BY o_custkey
    UNION ALL SELECT c_custkey, '' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for each customer's orders; customers without any are empty messages."""
    facts = R.statements(spark, sf_dir, "orders", ["o_orderstatus"], msg=F.col("o_custkey"))
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("msg_id"))
    return nquads.message_texts(facts, ids.unionByName(facts.select("msg_id").distinct()))


@query("""SELECT CAST(user_id AS BIGINT) AS msg_id, '_:m' || user_id || '_e' || event_id AS s, '<urn:t:event_type>' AS p, '"' || event_type || '"^^<http://www.w3.org/2001/XMLSchema#string>' AS o FROM events""")
def blank_nodes_of_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank labels are a message's own, however often a label is used."""
    facts = R.statements(spark, sf_dir, "events", ["event_type"], msg=F.col("user_id"))
    blank = facts.withColumn("s", F.regexp_replace("s", r"^<urn:t:events/(\d+)>$", "_:e$1"))
    return nquads.read_message_table(nquads.message_texts(blank)).select("msg_id", "s", "p", "o")


@query(f"""SELECT {key('customer', 'c_custkey')} AS s, '<urn:t:c_mktsegment>' AS p, {text('c_mktsegment')} AS o FROM customer""")
def nquads_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as line files and read again."""
    path = FactStore.temporary(spark, "nquads").folder + "-files"
    nquads.write_nquads(R.statements(spark, sf_dir, "customer", ["c_mktsegment"]), path)
    return nquads.read_nquads(spark, path).select("s", "p", "o")


# --- reports and emission -------------------------------------------------------------------------------------------


@query(f"""SELECT {key('customer', 'c_custkey')} || ' is in the disjoint classes <urn:x:BUILDING> and <urn:x:Afloat>' AS message, 3 AS terms,
      {key('customer', 'c_custkey')} || ' {T} <urn:x:BUILDING> .' AS evidence FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7""")
def reports_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as statements that outlast an output contract, grouped again to rows, with sentence and evidence."""
    segments = link(spark, sf_dir, "customer", customer_iri(), TYPE, F.concat(F.lit("<urn:x:"), "c_mktsegment", F.lit(">")))
    facts = R.statements(spark, sf_dir, "customer", ["c_nationkey"]).unionByName(segments)
    ontology = "[ owl:onProperty t:c_nationkey; owl:hasValue <urn:t:nation/7> ] rdfs:subClassOf x:Afloat. x:BUILDING owl:disjointWith x:Afloat."
    nothing = "x:S a sh:NodeShape; sh:targetSubjectsOf x:none; sh:property [ sh:path x:none ]."
    out, _ = Engine(spark).load(HEAD + ontology, ["owl2rl"], shapes_out=HEAD + nothing).infer_with_diagnostics(facts)
    rows = emit.explained(emit.grouped_reports(out))
    return rows.select("message", F.size("terms").alias("terms"), F.col("evidence")[0].alias("evidence"))


@query(f"""WITH c AS (SELECT {key('customer', 'c_custkey')} AS c, row_number() OVER (ORDER BY {key('customer', 'c_custkey')}) AS k FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT '<urn:x:BUILDING> <urn:x:Builder> ' || c AS terms FROM c WHERE k <= 20""")
def first_twenty_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a display shows: the first twenty reports by message, rule and terms."""
    segments = link(spark, sf_dir, "customer", customer_iri(), TYPE, F.concat(F.lit("<urn:x:"), "c_mktsegment", F.lit(">")))
    _, found = Engine(spark).load(HEAD + "x:BUILDING rdfs:subClassOf x:Builder; owl:disjointWith x:Builder.", ["owl2rl"]).infer_with_diagnostics(segments)
    return emit.first_reports(found).select(F.concat_ws(" ", "terms").alias("terms"))


@query(f"""SELECT 'application' AS mode, {key('nation', 'n_nationkey')} AS s, '<urn:x:plain>' AS p FROM nation
    UNION ALL SELECT 'conformance', {key('nation', 'n_nationkey')}, p FROM nation, (VALUES ('<urn:x:plain>'), ('<urn:x:made>')) v(p)""")
def output_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Application mode hides what names a minted node; internal predicates and x sameAs x never leave."""
    rules = """{ ?n t:n_name ?v. ("k" ?n) log:skolem ?k } => { ?n x:made ?k }. { ?n t:n_name ?v } => { ?n x:plain ?v. ?n internal:hidden ?v. ?n owl:sameAs ?n }."""
    engine = Engine(spark).load("", [Profile(HEAD + rules)])
    facts = R.statements(spark, sf_dir, "nation", ["n_name"])
    modes = [engine.infer(facts, mode=m).select(F.lit(m).alias("mode"), "s", "p") for m in ("application", "conformance")]
    return modes[0].unionByName(modes[1])


@query(f"""SELECT DISTINCT {text('n_name')} AS s, c AS o FROM nation, (VALUES ('<http://www.w3.org/2001/XMLSchema#string>'), ('<http://www.w3.org/2000/01/rdf-schema#Literal>')) v(c)""")
def literal_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals are instances of their datatypes; visible in conformance mode."""
    out = Engine(spark).load("", ["owl2rl"]).infer(R.statements(spark, sf_dir, "nation", ["n_name"]), mode="conformance")
    return out.where((F.col("p") == TYPE) & is_literal(F.col("s"))).select("s", "o")


@query(f"""WITH l AS (SELECT DISTINCT '"' || p_size || '"^^<{XSD.integer[1:]}' AS a, '"' || p_size || '.0"^^<{XSD.decimal[1:]}' AS b, p_size FROM part),
      e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)
    SELECT a AS s, '{SAME_AS}' AS p, b AS o FROM e UNION ALL SELECT a, 'canonical', a FROM l UNION ALL SELECT b, 'canonical', b FROM l""")
def literal_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of one value are the same (a join on the value, not all pairs); canonical forms of all."""
    facts = R.statements(spark, sf_dir, "part", ["p_size"])
    decimal = facts.withColumn("o", make_literal(F.concat(lexical_form(F.col("o")), F.lit(".0")), XSD.decimal))
    both = facts.unionByName(decimal)
    forms = literals.canonical_forms(both).select("s", F.lit("canonical").alias("p"), canonical(F.col("o")).alias("o"))
    return literals.equalities(both).select("s", "p", "o").unionByName(forms)


@query(f"""SELECT {key('customer', 'c_custkey')} AS s, '<urn:x:livesIn>' AS p, {key('nation', 'c_nationkey')} AS o FROM customer
    UNION SELECT {key('nation', 'c_nationkey')}, '{T}', '<urn:x:Place>' FROM customer""")
def engine_as_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loaded engine's rules and closed background as a SQL program, executed on its own."""
    facts = R.statements(spark, sf_dir, "customer", ["c_nationkey"])
    engine = Engine(spark).load(HEAD + "t:c_nationkey rdfs:subPropertyOf x:livesIn. x:livesIn rdfs:range x:Place.", ["owl2rl"])
    return sql.execute(spark, engine.sql_program(facts).program, facts, max_facts=10**12)["derived"].select("s", "p", "o")


@query(f"""SELECT {key('customer', 'c_custkey')} AS s, '<urn:x:livesIn>' AS p FROM customer""")
def saved_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine that is saved, loaded again and given contracts for input and output."""
    folder = FactStore.temporary(spark, "runtime").folder + "-saved"
    shapes_in = HEAD + "x:S a sh:NodeShape; sh:closed true; sh:targetSubjectsOf t:c_nationkey; sh:property [ sh:path t:c_nationkey ]."
    shapes_out = HEAD + "x:O a sh:NodeShape; sh:targetSubjectsOf x:livesIn; sh:property [ sh:path x:livesIn ]."
    Engine(spark).load(HEAD + "t:c_nationkey rdfs:subPropertyOf x:livesIn. t:c_name rdfs:subPropertyOf x:livesIn. x:livesIn rdfs:range x:Place.", ["owl2rl"], shapes_in=shapes_in, shapes_out=shapes_out).save_runtime(folder)
    return Engine(spark, runtime=folder).infer(R.statements(spark, sf_dir, "customer", ["c_nationkey", "c_name"])).select("s", "p")


# --- shapes and paths -----------------------------------------------------------------------------------------------


@query(f"""SELECT {key('customer', 'c_custkey')} AS focus, 'MinCount' AS component, '' AS value FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
    UNION ALL SELECT '<urn:t:nation/3>', 'Class', '<urn:t:nation/3>'""")
def shape_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by class with subclasses, by node; shapes that are switched off say nothing."""
    facts = R.statements(spark, sf_dir, "customer", ["c_nationkey"]).unionByName(link(spark, sf_dir, "customer", customer_iri(), TYPE, F.concat(F.lit("<urn:x:"), "c_mktsegment", F.lit(">"))))
    shapes = """x:BUILDING rdfs:subClassOf x:Works. x:MACHINERY rdfs:subClassOf x:Works. x:S a sh:NodeShape; sh:targetClass x:Works; sh:property [ sh:path x:none; sh:minCount 1 ].
        x:N a sh:NodeShape; sh:targetNode <urn:t:nation/3>; sh:class x:Nation. x:Off a sh:NodeShape; sh:deactivated true; sh:targetObjectsOf t:c_nationkey; sh:class x:Nation."""
    return violations(spark, facts, shapes)


@query(f"""SELECT {key('customer', 'c_custkey')} AS focus, 'In' AS component, '<urn:x:given>' AS value FROM customer
    UNION ALL SELECT {key('customer', 'c_custkey')}, 'Class', '<urn:x:default>' FROM customer UNION ALL SELECT {key('customer', 'c_custkey')}, 'SingleLine', '"' || c_name || chr(10) || '"{STR}' FROM customer
    UNION ALL SELECT DISTINCT {key('nation', 'c_nationkey')}, 'MinCount', '' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)
    UNION ALL SELECT {key('customer', 'c_custkey')}, 'Xone', {key('customer', 'c_custkey')} FROM customer""")
def shape_newer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sh:values, sh:defaultValue, single lines, property shapes below a value, and lists of twice the same shape."""
    facts = R.several(spark, sf_dir, {"customer": ["c_nationkey"], "supplier": ["s_nationkey"]})
    names = R.statements(spark, sf_dir, "customer", ["c_name"]).withColumn("o", make_literal(F.concat(lexical_form(F.col("o")), F.lit("\n")), XSD.string))
    shapes = """x:S a sh:NodeShape; sh:targetSubjectsOf t:c_nationkey; sh:xone (x:o x:o); sh:property [ sh:path x:none; sh:values x:given; sh:in (x:other) ], [ sh:path x:void; sh:defaultValue x:default; sh:class x:C ],
        [ sh:path t:c_name; sh:singleLine true ], [ sh:path t:c_nationkey; sh:property [ sh:path [ sh:inversePath t:s_nationkey ]; sh:minCount 1 ] ]."""
    return violations(spark, facts.unionByName(names), shapes)


@query("""SELECT CAST(user_id AS BIGINT) AS msg_id, bool_and(event_type <> 'error') AS conforms FROM events GROUP BY user_id""")
def shape_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message conforms if it has no result of a disallowed severity: warnings are allowed, violations aren't."""
    facts = R.statements(spark, sf_dir, "events", ["event_type"], msg=F.col("user_id"))
    shapes = """x:S a sh:NodeShape; sh:targetSubjectsOf t:event_type; sh:property [ sh:path t:event_type; sh:pattern "^(?!error)" ], [ sh:path t:event_type; sh:severity sh:Warning; sh:maxLength 4 ]."""
    from quadloom.vocab import SH

    return conforms(facts, Validator(parse_triples(HEAD + shapes)).validate(facts), [SH.Violation])


@query(f"""SELECT {key('part', 'p_partkey')} AS focus, '<urn:t:p_size>' AS path, 'MaxInclusive' AS component FROM part WHERE p_size > 30 UNION ALL SELECT {key('part', 'p_partkey')}, '<urn:t:p_size>', 'MinExclusive' FROM part WHERE p_size <= 10""")
def shape_result_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as statements of the validation vocabulary, read back by focus, path and component."""
    from quadloom.vocab import SH

    facts = R.statements(spark, sf_dir, "part", ["p_size"])
    shapes = "x:S a sh:NodeShape; sh:targetSubjectsOf t:p_size; sh:property [ sh:path t:p_size; sh:maxInclusive 30; sh:minExclusive 10 ]."
    graph = result_statements(Validator(parse_triples(HEAD + shapes)).validate(facts))
    of = lambda p, name: graph.where(F.col("p") == p).select(F.col("s").alias("id"), F.col("o").alias(name))
    met = of(SH.focusNode, "focus").join(of(SH.resultPath, "path"), "id").join(of(SH.sourceConstraintComponent, "c"), "id")
    return met.select("focus", "path", F.regexp_extract("c", r"#(\w+)ConstraintComponent", 1).alias("component"))


@query("""WITH RECURSIVE e AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
    g AS (SELECT a, b FROM e WHERE b IS NOT NULL), r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b),
    n AS (SELECT a FROM g UNION SELECT b FROM g), k(x) AS (VALUES ('plus'), ('option'), ('sequence'))
    SELECT kind, '<urn:t:events/' || a || '>' AS a, '<urn:t:events/' || b || '>' AS b FROM (
      SELECT 'plus' AS kind, a, b FROM r UNION ALL SELECT 'option', a, b FROM (SELECT a, b FROM g UNION SELECT a, a FROM n) UNION ALL SELECT 'back', x.b, y.a FROM g x JOIN g y ON y.b = x.a)""")
def path_plus_option_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or more, none or one, and a sequence of inverse steps."""
    facts, step = successors(spark, sf_dir), Path("predicate", iri_of("before"))
    back = Path("inverse", parts=(step,))
    kinds = {"plus": Path("+", parts=(step,)), "option": Path("?", parts=(step,)), "back": Path("sequence", parts=(back, back))}
    out = [df.select(F.lit(k).alias("kind"), "a", "b") for k, df in zip(kinds, evaluate_all(list(kinds.values()), facts), strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT '<urn:t:user/' || user_id || '>' AS focus, count(*) AS many, 1 AS one FROM events GROUP BY user_id""")
def compact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each focus: one value of a scalar path, all of a repeated one."""
    facts = R.statements(spark, sf_dir, "events", ["user_id"])
    turned = facts.where(F.col("p") == R.predicate("user_id")).select("msg_id", F.col("o").alias("s"), F.lit(iri_of("did")).alias("p"), F.col("s").alias("o"))
    first = turned.withColumn("p", F.lit(iri_of("first")))
    typed = turned.select("msg_id", "s", F.lit(TYPE).alias("p"), F.lit(iri_of("User")).alias("o")).distinct()
    graph = shape_plan.compile_shapes(parse_triples(HEAD + "x:S a sh:NodeShape; sh:targetClass x:User; sh:property [ sh:path x:did ], [ sh:path x:first; sh:maxCount 1 ]."))
    rows = shape_plan.compact_records(turned.unionByName(first).unionByName(typed), graph)
    return rows.select("focus", F.size(F.col("slots")[iri_of("did")]).cast("long").alias("many"), F.size(F.col("slots")[iri_of("first")]).alias("one"))


# --- quantity nodes -------------------------------------------------------------------------------------------------


@query("""SELECT s, round(value, 6) AS value, unit FROM (
      SELECT '<urn:t:part/' || p_partkey || '>' AS s, p_size * CAST(0.5144444444444445 AS DOUBLE) AS value, 'M-PER-SEC' AS unit FROM part
      UNION ALL SELECT '<urn:t:nation/' || n_nationkey || '>', n_nationkey + CAST(273.15 AS DOUBLE), 'K' FROM nation
      UNION ALL SELECT '<urn:t:region/' || r_regionkey || '>', pow(10.0, CAST(r_regionkey AS DOUBLE)), 'UNITLESS' FROM region)""")
def quantity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a number and a unit: a local unit aligned with knots, a temperature by the profile of its property, and bels as ratios."""
    def nodes(table: str, pk: str, number: str, prop: str, unit: str) -> DataFrame:
        node = F.concat(F.lit(f"<urn:x:{table}-q/"), F.col(pk).cast("string"), F.lit(">"))
        out = link(spark, sf_dir, table, R.iri(table, F.col(pk)), prop, node)
        out = out.unionByName(link(spark, sf_dir, table, node, QUDT.numericValue, make_literal(F.col(number).cast("string"), XSD.integer)))
        return out.unionByName(link(spark, sf_dir, table, node, QUDT.unit, F.lit(unit)))

    facts = nodes("part", "p_partkey", "p_size", iri_of("speed"), iri_of("ownKnot")).unionByName(nodes("nation", "n_nationkey", "n_nationkey", iri_of("temperature"), UNIT.DEG_C))
    facts = facts.unionByName(nodes("region", "r_regionkey", "r_regionkey", iri_of("level"), UNIT.B))
    units = Engine(spark).load(HEAD + "x:ownKnot skos:exactMatch unit:KN. x:temperature norm:normalizationProfile norm:TemperatureProfile.", ["qudt"]).units
    made = quantities.normalise(facts, units)
    node = made.where(F.col("p").endswith("normalizedQuantity>")).select("s", F.col("o").alias("q"))
    value = made.where(F.col("p") == QUDT.numericValue).select(F.col("s").alias("q"), F.round(lexical_form(F.col("o")).cast("double"), 6).alias("value"))
    unit = made.where(F.col("p") == QUDT.unit).select(F.col("s").alias("q"), F.regexp_extract("o", r"/([^/>]+)>$", 1).alias("unit"))
    return node.join(value, "q").join(unit, "q").select("s", "value", "unit")


@query("""SELECT '<urn:t:part/' || p_partkey || '>' AS s, round(p_size * CAST(1000 AS DOUBLE), 6) AS value, 'PA' AS unit, '<urn:x:pressure>' AS property FROM part""")
def legacy_quantity_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of the older datatypes, with where they came from; what is normalised isn't normalised again."""
    facts = link(spark, sf_dir, "part", R.iri("part", F.col("p_partkey")), iri_of("pressure"), make_literal(F.concat(F.col("p_size").cast("string"), F.lit(" kPa")), LCDT.pressure))
    units = Engine(spark).load("", ["qudt"]).units
    made = stored(quantities.normalise(facts, units), "once")
    made = made.unionByName(quantities.normalise(facts.unionByName(made), units)).distinct()
    node = made.where(F.col("p").endswith("normalizedQuantity>")).select("s", F.col("o").alias("q"))
    of = lambda end, name: made.where(F.col("p").endswith(end)).select(F.col("s").alias("q"), F.col("o").alias(name))
    met = node.join(of("/numericValue>", "n"), "q").join(of("/unit>", "u"), "q").join(of("sourceProperty>", "property"), "q")
    return met.select("s", F.round(lexical_form(F.col("n")).cast("double"), 6).alias("value"), F.regexp_extract("u", r"/([^/>]+)>$", 1).alias("unit"), "property")
