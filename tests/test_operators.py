from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.data import BROAD, DB_XREF, EXACT, NARROW, A, B, C, D, line, ref, row, rows, triples
from veldspan.operators import assemble as asm
from veldspan.operators import chains, components, counts, filters, hierarchy, infer, many, prioritize
from veldspan.schema import CHAIN, CLOSE, INVERSION, KNOWLEDGE, LEXICAL, MANUAL, SUBCLASS

R1, R2, R3, R4 = ref(A, 1), ref(B, 2), ref(C, 3), ref(D, 4)


def exact(s, o, c=0.95, **how):
    return row(s, EXACT, o, c, **how)


def test_flip(spark):
    out = infer.flip(rows(spark, exact(R1, R2), row(R1, NARROW, R3), row(R1, BROAD, R4), row(R2, DB_XREF, R3)))
    assert triples(out) == {(R2, EXACT, R1), (R3, BROAD, R1), (R4, NARROW, R1)}
    for r in out.collect():
        assert (r.ev_type, r.justification, r.confidence) == ("reasoned", INVERSION, 1.0) and len(r.derived_from) == 1
    with pytest.raises(ValueError, match="no inverse"):
        infer.flip(rows(spark, row(R2, DB_XREF, R3)), strict=True)


def test_flip_twice_gives_the_same_triples(spark):
    df = rows(spark, exact(R1, R2), row(R1, NARROW, R3), row(R4, BROAD, R2), row(R1, CLOSE, R4))
    assert triples(infer.flip(infer.flip(df))) == triples(df)


def test_assemble_keeps_each_evidence_once(spark):
    df = rows(spark, exact(R1, R2, justification=LEXICAL), exact(R1, R2, justification=MANUAL), exact(R1, R2, justification=MANUAL, ms_id="other"), exact(R1, R3))
    out = asm.assemble(df)
    assert out.count() == 3 and sorted(map(tuple, asm.assemble(out).collect())) == sorted(map(tuple, out.collect()))
    assert {(r.s_id, r.o_prefix): r.n_evidence for r in asm.mappings(out).collect()} == {("0000001", B): 2, ("0000001", C): 1}


def test_confidence_is_noisy_or(spark):
    df = rows(spark, exact(R1, R2, 0.99), exact(R1, R2, 0.94), exact(R1, R2, 0.8, justification=LEXICAL), exact(R1, R3, None), exact(R1, R4, 0.0))
    got = {r.o_prefix: r.confidence for r in asm.mappings(df).collect()}
    assert got[B] == pytest.approx(1 - 0.01 * 0.06 * 0.2) and got[C] is None and got[D] is None


def test_nested_and_flat_are_inverse(spark):
    df = asm.assemble(rows(spark, exact(R1, R2), exact(R1, R2, author="x"), row(R2, BROAD, R3)))
    assert sorted(map(str, asm.flat(asm.nested(df)).collect())) == sorted(map(str, df.collect()))


def test_titles_reach_derived_mappings(spark):
    sets = spark.createDataFrame([("a", "Set A"), ("b", "Set B")], "ms_id string, title string")
    df = infer.reverse(rows(spark, exact("mesh:D1", "doid:2", ms_id="b"), exact("mesh:D1", "doid:2", author="x", ms_id="a")))
    got = {r.s_prefix: r.mapping_sets for r in asm.mapping_set_titles(df, sets).collect()}
    assert got == {"mesh": "Set A|Set B", "doid": "Set A|Set B"}


def test_filters(spark):
    a1, a2, b1, b2, c1 = ref(A, 1), ref(A, 2), ref(B, 1), ref(B, 2), ref(C, 1)
    df = rows(spark, exact(a1, b1), exact(a2, b2), exact(a1, c1), exact(a1, a2))
    assert triples(filters.keep_prefixes(df, {A, B})) == {(a1, EXACT, b1), (a2, EXACT, b2), (a1, EXACT, a2)}
    assert triples(filters.drop_self_matches(df)) == {(a1, EXACT, b1), (a2, EXACT, b2), (a1, EXACT, c1)}
    assert triples(filters.drop_prefixes(df, "hpo")) == {(a1, EXACT, b1), (a2, EXACT, b2), (a1, EXACT, a2)}
    assert triples(filters.keep_object_prefixes(df, [B])) == {(a1, EXACT, b1), (a2, EXACT, b2)}
    assert triples(filters.drop_triples(df, rows(spark, exact(a2, b2), exact(c1, a1)))) == {(a1, EXACT, b1), (a1, EXACT, c1), (a1, EXACT, a2)}
    assert (a1, EXACT, c1) not in triples(filters.drop_triples(df, rows(spark, exact(c1, a1)), symmetric=True))
    with pytest.raises(ValueError, match="unknown prefix"):
        filters.keep_prefixes(df, ["nope"])


def test_minimum_confidence(spark):
    df = rows(spark, row(R1, DB_XREF, R2, 0.95), row(R1, DB_XREF, R2, 0.65), row(R1, DB_XREF, R3, None))
    assert [r.confidence for r in filters.minimum_confidence(df, 0.7).collect()] == [0.95]
    assert filters.minimum_confidence(df, 0.98, assembled=True).count() == 2


def test_subsets(spark):
    a1, a2, b1, b2, c1 = ref(A, 1), ref(A, 2), ref(B, 1), ref(B, 2), ref(C, 1)
    df = rows(spark, exact(a1, b1), exact(b1, a1), exact(a2, b2), exact(b2, a2), exact(b1, c1), exact(c1, b1))
    terms = spark.createDataFrame([tuple(x.split(":")) for x in (a1, a2, b1)], "prefix string, id string")
    assert triples(filters.keep_subsets(df, terms)) == {(a1, EXACT, b1), (b1, EXACT, a1), (b1, EXACT, c1), (c1, EXACT, b1)}


def test_violations(spark):
    df = rows(spark, exact("doid:1", "mesh:D1"), exact("do:1", "mesh:D1"), exact("doid:1", "mesh:x"), exact("doid:a:b", "mesh:D1"))
    got = {(r.s_prefix, r.s_id, r.o_id): r.problem for r in filters.violations(df).collect()}
    assert got == {("do", "1", "D1"): "invalid subject prefix", ("doid", "1", "x"): "invalid object identifier", ("doid", "a:b", "D1"): "colon in subject"}
    with pytest.raises(ValueError, match="invalid mappings"):
        filters.validate(df)
    assert filters.validate(df.limit(1)).count() == 1


def test_many_to_many(spark):
    a1, a2, a3, b1, b2, b3 = (ref(p, n) for p in (A, B) for n in (1, 2, 3))
    m1, m2, m3, m4 = exact(a1, b1), exact(a1, b3), exact(a2, b2), exact(a3, b2)
    assert triples(many.many_to_many(rows(spark, m1, m2, m3))) == {(a1, EXACT, b1), (a1, EXACT, b3)}
    assert triples(many.many_to_many(rows(spark, m2, m3, m4))) == {(a2, EXACT, b2), (a3, EXACT, b2)}
    assert triples(many.drop_many_to_many(rows(spark, m1, m2, m3))) == {(a2, EXACT, b2)}
    # the same pair by two predicates isn't many-to-many
    assert many.many_to_many(rows(spark, m1, row(a1, BROAD, b1))).isEmpty()


def test_project(spark):
    a1, a2, b1, b2, c1 = ref(A, 1), ref(A, 2), ref(B, 1), ref(B, 2), ref(C, 1)
    df = rows(spark, exact(a1, b1), exact(a2, b2), exact(b2, a2), exact(a1, c1))
    good, bad = many.project(df, A, B)
    assert triples(good) == {(a1, EXACT, b1), (a2, EXACT, b2)} and bad.isEmpty()
    assert many.project_dict(df, A, B) == {"0000001": "0000001", "0000002": "0000002"}


E3 = [(R1, EXACT, R2), (R2, EXACT, R3), (R3, EXACT, R4)]


def test_chains_of_exact(spark):
    two = chains.infer_chains(line(spark, R1, EXACT, R2, EXACT, R3), backwards=False)
    assert triples(two) == {*E3[:2], (R1, EXACT, R3)}
    (found,) = [r for r in two.collect() if r.ev_type == "reasoned"]
    assert found.justification == CHAIN and found.explanation == f"{R1} {R2} {R3}" and len(found.derived_from) == 2 and found.confidence == 1.0
    three = chains.infer_chains(line(spark, R1, EXACT, R2, EXACT, R3, EXACT, R4), backwards=False)
    assert triples(three) == {*E3, (R1, EXACT, R3), (R1, EXACT, R4), (R2, EXACT, R4)}


@pytest.mark.parametrize(
    ("steps", "new"),
    [
        ((R1, EXACT, R2, BROAD, R3, EXACT, R4), BROAD),
        ((R1, BROAD, R2, EXACT, R3, BROAD, R4), BROAD),
        ((R1, EXACT, R2, NARROW, R3), NARROW),
    ],
)
def test_chains_with_broad_and_narrow(spark, steps, new):
    nodes = steps[::2]
    df = line(spark, *steps)
    back = {BROAD: NARROW, NARROW: BROAD}[new]
    jumps = {(nodes[i], nodes[j]) for i in range(len(nodes)) for j in range(i + 2, len(nodes))}
    forward = {(a, new, b) for a, b in jumps}
    assert triples(chains.infer_chains(df, backwards=False)) == triples(df) | forward
    assert triples(chains.infer_chains(df)) == triples(df) | forward | {(b, back, a) for a, b in jumps}


def test_no_chain_over_narrow_and_broad_nor_within_a_prefix(spark):
    for steps in ((R1, NARROW, R2, BROAD, R3), (R1, BROAD, R2, NARROW, R3), (ref(A, 1), EXACT, ref(A, 2), EXACT, ref(A, 3)), (R1, EXACT, R2, EXACT, ref(A, 9))):
        df = line(spark, *steps)
        assert triples(chains.infer_chains(df)) == triples(df)


def test_reverse_then_chain(spark):
    df = infer.reverse(line(spark, R1, EXACT, R2, NARROW, R3))
    assert triples(df) == {(R1, EXACT, R2), (R2, NARROW, R3), (R2, EXACT, R1), (R3, BROAD, R2)}
    assert triples(chains.infer_chains(df)) == triples(df) | {(R1, NARROW, R3), (R3, BROAD, R1)}


def test_the_direction_of_a_path_counts(spark):
    df = line(spark, R4, EXACT, R2, EXACT, R1)
    assert triples(chains.infer_chains(df, backwards=False)) == triples(df) | {(R4, EXACT, R1)}


def test_an_edge_of_any_predicate_blocks_a_chain(spark):
    df = rows(spark, exact(R1, R2), exact(R2, R3), row(R1, DB_XREF, R3))
    assert triples(chains.infer_chains(df, backwards=False)) == triples(df)


def test_component_limits(spark):
    df = line(spark, R1, EXACT, R2, EXACT, R3, EXACT, R4)
    assert triples(chains.infer_chains(df, above=4)) == triples(df) == triples(chains.infer_chains(df, most=3))
    assert (R1, EXACT, R4) not in triples(chains.infer_chains(df, cutoff=2))


def test_component_counts(spark):
    a1, a2, b1, b2, c1 = ref(A, 1), ref(A, 2), ref(B, 1), ref(B, 2), ref(C, 1)
    df = rows(spark, exact(a1, b1), exact(b1, c1), exact(a2, b2), row(a2, DB_XREF, b2))
    got = {tuple(r.prefixes): r.n for r in components.component_sizes(df, [A, B, C]).collect()}
    assert got == {tuple(sorted((A, B))): 1, tuple(sorted((A, B, C))): 1}
    assert {r.n_prefixes: r.n for r in components.coverage_sizes(df, [A, B, C]).collect()} == {1: 0, 2: 1, 3: 1}
    assert {tuple(r.prefixes): r.n for r in components.component_sizes(df, [D]).collect()} == {(): 1}


def test_components_against_brute_force(spark):
    import random

    rng = random.Random(7)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    df = rows(spark, *(exact(ref(A, a), ref(B, b)) for a, b in pairs))
    group = {x: {x} for p in pairs for x in (ref(A, p[0]), ref(B, p[1]))}
    for a, b in pairs:
        both = group[ref(A, a)] | group[ref(B, b)]
        for x in both:
            group[x] = both
    got = {f"{r.prefix}:{r.id}": r.component for r in components.components(df).collect()}
    assert got == {x: min(g) for x, g in group.items()}


CLIQUE = [(x, y) for x in (R1, R2, R3) for y in (R1, R2, R3) if x != y]


@pytest.mark.parametrize(
    ("priority", "hub"), [([D], None), ([D, A], R1), ([A], R1), ([B], R2), ([C], R3)],
)
def test_prioritize(spark, priority, hub):
    df = rows(spark, *(exact(a, b) for a, b in CLIQUE))
    want = {(x, EXACT, hub) for x in (R1, R2, R3) if hub and x != hub}
    out = prioritize.prioritize(df, priority)
    assert triples(out) == want
    assert prioritize.check_projection(out) is out


def test_prioritize_drops_members_without_an_edge(spark):
    df = rows(spark, exact(R1, R2), exact(R2, R3))
    assert triples(prioritize.prioritize(df, [A])) == set()
    assert triples(prioritize.prioritize(df, [C])) == {(R2, EXACT, R3)}


def test_ties_go_to_the_least_identifier_and_order(spark):
    a1, a2 = ref(A, 1), ref(A, 2)
    df = rows(spark, exact(R2, a2), exact(R2, a1), exact(R3, a1))
    out = prioritize.in_order(prioritize.prioritize(df, [A]), [A])
    assert [(r.s_prefix, r.o_id) for r in out.collect()] == [(C, "0000001"), (B, "0000001")]


def test_prioritize_column(spark):
    stars = rows(spark, exact("doid:1", "mesh:D1"), exact("doid:2", "mesh:D2"))
    df = spark.createDataFrame([("r1", "doid:1"), ("r2", "DO:2"), ("r3", "doid:3"), ("r4", "what is this"), ("r5", None)], "label string, curie string")
    got = {r.label: r.curie_prioritized for r in prioritize.prioritize_column(stars, df, column="curie").collect()}
    assert got == {"r1": "mesh:D1", "r2": "mesh:D2", "r3": "doid:3", "r4": "what is this", "r5": None}
    with pytest.raises(ValueError, match="not a projection"):
        prioritize.prioritize_column(rows(spark, exact("doid:1", "mesh:D1"), exact("doid:1", "mesh:D2")), df, column="curie")


def test_terms_move_to_the_preferred_reference(spark):
    terms = spark.createDataFrame(
        [("x", "x", "doid", "1", "X", "name", "s", None, None, None), ("x", "x", "mesh", "D1", "X", "synonym", "s", None, None, None), ("y", "y", "efo", "1", "Y", "name", "s", None, None, None)],
        "text string, norm_text string, db string, id string, entry_name string, status string, source string, organism string, source_db string, source_id string",
    )
    out = prioritize.reprioritize_terms(terms, rows(spark, exact("doid:1", "mesh:D1"))).collect()
    assert sorted((r.text, r.db, r.id, r.status, r.source_db, r.source_id) for r in out) == [("x", "mesh", "D1", "name", "doid", "1"), ("y", "efo", "1", "name", None, None)]
    assert prioritize.standardize_terms(terms.withColumn("db", F.lit("MSH"))).first().db == "mesh"


def test_mutations(spark):
    df = rows(spark, row(R1, DB_XREF, R2, 0.95), row(R2, DB_XREF, R1, 0.95))
    out = infer.mutate(df, {(A, B): 0.8}, DB_XREF, EXACT)
    (new,) = [r for r in out.collect() if r.p == EXACT]
    assert new.confidence == pytest.approx(1 - 0.05 * 0.2) and new.justification == KNOWLEDGE and out.count() == 3
    assert [r.confidence for r in infer.mutate_dbxrefs(df, [(A, B)]).where("ev_type = 'reasoned'").collect()] == [pytest.approx(1 - 0.3 * 0.05)]
    assert triples(infer.mutate_mutual_dbxrefs(df, [A, B])) == {(R1, DB_XREF, R2), (R2, DB_XREF, R1), (R1, EXACT, R2), (R2, EXACT, R1)}


@pytest.mark.parametrize(
    ("target", "hits"), [(B, {B}), ([B, C], {B, C}), (None, {B, C, D})],
)
def test_mutation_rules(spark, target, hits):
    df = rows(spark, *(row(R1, DB_XREF, x) for x in (R2, R3, R4)), *(exact(R1, x) for x in (R2, R3)), *(row(x, DB_XREF, R1) for x in (R2, R3)))
    got = {r.o_prefix for r in df.where(infer.Mutation(A, target).applies).collect()}
    assert got == hits
    out = infer.replace_predicates(df.where("p <> 'skos:exactMatch'"), [infer.Mutation(A, target, 0.9)])
    assert {r.o_prefix for r in out.where("p = 'skos:exactMatch'").collect()} == hits and out.count() == 5


def test_one_mutation_for_each_source(spark):
    with pytest.raises(KeyError):
        infer.replace_predicates(rows(spark), [infer.Mutation(A, B), infer.Mutation(A, C)])


def test_generalize(spark):
    assert triples(infer.generalize(rows(spark, row(R1, SUBCLASS, R2)))) == {(R1, SUBCLASS, R2), (R1, BROAD, R2)}


def test_index_and_terms(spark):
    df = rows(spark, exact("doid:1", "mesh:A"), exact("doid:1", "efo:X"))
    got = {(r.left_prefix, r.right_prefix): r.id for r in counts.identifier_index(df).collect()}
    assert got == {("doid", "mesh"): "1", ("mesh", "doid"): "A", ("doid", "efo"): "1", ("efo", "doid"): "X"}
    assert {(r.prefix, r.id) for r in counts.observed_terms(df).collect()} == {("doid", "1"), ("mesh", "A"), ("efo", "X")}
    assert counts.source_target_table(df).splitlines()[2:] == ["| doid | efo | 1 |", "| doid | mesh | 1 |"]
    assert {r.prefix: r.name for r in counts.summarize_prefixes(df).collect()}["mesh"] == "Medical Subject Headings"


def test_descendants_end_on_cycles(spark):
    edges = [("x", "2", "x", "1"), ("x", "3", "x", "2"), ("x", "1", "x", "3"), ("y", "4", "x", "3")]
    is_a = spark.createDataFrame(edges, "child_prefix string, child_id string, parent_prefix string, parent_id string")
    roots = spark.createDataFrame([("x", "1")], "prefix string, id string")
    assert {(r.prefix, r.id) for r in hierarchy.descendants(is_a, roots).collect()} == {("x", "1"), ("x", "2"), ("x", "3"), ("y", "4")}
    assert hierarchy.descendants(is_a, roots.limit(0)).isEmpty()
    subset = hierarchy.hydrate_subsets(spark.createDataFrame([("y", "x", "1")], "prefix string, ref_prefix string, ref_id string"), is_a)
    assert [tuple(r) for r in subset.collect()] == [("y", "4")]
    terms = spark.createDataFrame([("y", "4"), ("y", "5"), ("y", "y#4"), ("z", "1")], "prefix string, id string")
    assert {tuple(r) for r in hierarchy.vocabulary_terms(terms, ["y", "z"], subset).collect()} == {("y", "4"), ("z", "1")}


def test_processing_derives_without_assembling_again(spark):
    """rows that nothing is derived from yet take a shorter way to the same evidence."""
    from veldspan.plans import assembly

    df = rows(spark, exact(R1, R2), exact(R1, R2, justification=MANUAL), row(R2, BROAD, R3, None), exact(R3, R4), row(R1, DB_XREF, R4), exact(R4, ref(A, 9)))
    wrong = rows(spark, exact(R4, R3), row(R1, BROAD, R4))
    got = assembly.process(df, negatives=wrong)
    long = infer.reverse(filters.drop_imprecise(asm.assemble(filters.drop_triples(df, wrong))))
    want = filters.drop_self_matches(filters.drop_triples(chains.infer_chains(long), wrong))
    key = lambda x: sorted(map(str, x.collect()))
    assert key(got) == key(want) == key(asm.assemble(got))
    again = assembly.process(got, negatives=wrong)
    assert triples(again) >= triples(got) and key(again) == key(asm.assemble(again))


def test_paths_keep_their_ids_and_nodes(spark):
    df = line(spark, R1, EXACT, R2, NARROW, R3)
    (path,) = chains.chain_paths(df).collect()
    ids = {f"{r.s_prefix}:{r.s_id}": r.tid for r in df.withColumn("tid", chains.hashed(*(chains.uri_of(x) for x in (F.concat("s_prefix", F.lit(":"), "s_id"), F.col("p"), F.concat("o_prefix", F.lit(":"), "o_id"))))).collect()}
    assert path.nodes == [R1, R2, R3] and path.ids == [ids[R1], ids[R2]] and path.known and path.p == NARROW


def test_confidences_are_those_of_the_evidence_kept(spark):
    df = rows(spark, exact(R1, R2, 0.9, ms_id="a"), exact(R1, R2, 0.9, ms_id="b"), exact(R1, R2, None), row(R1, BROAD, R3, 0.5)).unionByName(infer.flip(rows(spark, exact(R1, R2))))
    key = lambda x: sorted(map(str, x.select(*asm.TRIPLE, "confidence").collect()))
    assert key(asm.confidences(df)) == key(asm.deduplicate_evidence(df))
