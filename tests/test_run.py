"""A whole run over a small hand-made source, in full and as a delta."""

import json
import threading
import urllib.error
import urllib.request
from datetime import datetime

import pytest

from kinweave import profiles
from kinweave.operators.metadata import Metadata
from kinweave.plans import reads, views
from kinweave.plans.pipeline import Run, load_state
from kinweave.plans.service import Service, serve
from kinweave.schemas import METADATA
from kinweave.sources.tables import Catalogue, Sources

CONTROL = {
    "metadata_system": ["SYS_A,Alpha", "SYS_B,Beta"],
    "metadata_system_table": ["T_LEAD,SYS_A,lead,PT_LEAD", "T_QUOTE,SYS_A,quote,PT_QUOTE", "T_MEMBER,SYS_A,quote_member,", "T_APP,SYS_A,application,PT_APP", "T_CONTACT,SYS_A,contact_person,PT_CONTACT", "T_LINK,SYS_A,lead_contact,"],
    "metadata_party_type": ["PT_LEAD,a.lead", "PT_QUOTE,a.quote", "PT_MAIN,a.member.main", "PT_OTHER,a.member.other", "PT_APP,a.application.applicant", "PT_SPOUSE,a.application.spouse", "PT_CONTACT,a.contact"],
    "metadata_attribute_type": ["ATTR_FIRST_NAME,First Name,True,False", "ATTR_LAST_NAME,Last Name,True,False", "ATTR_EMAIL,Email Address,True,False", "ATTR_DOB,Date of Birth,True,False", "ATTR_GOV_ID,Government ID,True,True"],
    "metadata_attribute_subtype": ["SUB_HKID,ATTR_GOV_ID,HKID", "SUB_PASSPORT,ATTR_GOV_ID,Passport"],
    "metadata_relationship": ["R_MEMBER,False,False,False,C_MEMBER_QUOTE,C_QUOTE_ID,,,,LINK,1.0", "R_QUOTE,False,True,True,C_QUOTE_LEAD,C_LEAD_ID,,,,LINK,1.0", "R_APP,False,False,False,C_APP_KEYS,C_QUOTE_KEYS,,,,LINK,0.95", "R_CONTACT,False,False,False,C_LEAD_ID,C_CONTACT_ID,T_LINK,C_LINK_LEAD,C_LINK_CONTACT,LINK,1.0"],
    "metadata_relationship_type": ["RT,LINK,HARD"],
    "metadata_party_type_relationship": ["PTR,a.application.applicant,a.application.spouse,SPOUSE_OF,STRONG,False,True,Alpha,application"],
    "metadata_evidence_rule": ["SUB_HKID,0.50,1.0,1.0,1.0,True,10,d", "ATTR_EMAIL,0.30,0.5,,,True,8,d", "ATTR_DOB,0.25,0.5,,,True,6,d", "ATTR_FIRST_NAME,0.10,0.2,,,True,5,d", "ATTR_LAST_NAME,0.10,0.2,,,True,5,d"],
    "metadata_blocking_rule": ["RULE,DIFFERENT_HKID_BLOCKS_MATCH,CONFLICT,SUB_HKID,DIFFERENT_VALUES,,True,10,True,False,0.8,2026-01-01T00:00:00"],
}
PERSON = [("first", "ATTR_FIRST_NAME"), ("last", "ATTR_LAST_NAME"), ("dob", "ATTR_DOB"), ("email", "ATTR_EMAIL"), ("gov", "ATTR_GOV_ID")]


def columns():
    row = lambda i, t, c, attr, rel, cond, logic, pt, at: f"{i},Alpha,{t},{c},{attr},{rel},{cond},{'kind' if cond else ''},\"{logic}\",{pt},{at},1.0,0.9,False,False"
    out = [row("C_LEAD_ID", "lead", "lead_id", False, True, False, "", "", "")]
    out += [row(f"C_LEAD_{c}", "lead", c, True, False, False, "", "a.lead", t) for c, t in PERSON]
    out += [row("C_QUOTE_ID", "quote", "quote_id", False, True, False, "", "", ""), row("C_QUOTE_LEAD", "quote", "lead_id", False, True, False, "", "", ""), row("C_QUOTE_KEYS", "quote", "region|number", False, True, False, "", "", "")]
    out += [row("C_MEMBER_ID", "quote_member", "member_id", False, True, False, "", "", ""), row("C_MEMBER_QUOTE", "quote_member", "quote_id", False, True, False, "", "", "")]
    out += [row("C_MEMBER_KIND", "quote_member", "kind", False, False, True, "kind='Primary'", "a.member.main", ""), row("C_MEMBER_KIND", "quote_member", "kind", False, False, True, "kind IN ('Spouse','Child')", "a.member.other", "")]
    out += [row(f"C_MEMBER_{c}", "quote_member", c, True, False, False, "", pt, t) for pt in ("a.member.main", "a.member.other") for c, t in PERSON]
    out += [row("C_APP_ID", "application", "app_id", False, True, False, "", "", ""), row("C_APP_KEYS", "application", "region|number", False, True, False, "", "", "")]
    out += [row(f"C_APP_{r}_{c}", "application", f"{r}_{c}", True, False, False, "", f"a.application.{r}", t) for r in ("applicant", "spouse") for c, t in PERSON]
    out += [row("C_CONTACT_ID", "contact_person", "contact_id", False, True, False, "", "", "")]
    out += [row(f"C_CONTACT_{c}", "contact_person", c, True, False, False, "", "a.contact", t) for c, t in PERSON]
    return out + [row("C_LINK_LEAD", "lead_contact", "lead_id", False, True, False, "", "", ""), row("C_LINK_CONTACT", "lead_contact", "contact_id", False, True, False, "", "", "")]


JOHN, MARY = "John,Smith,1985-06-15,john@x.com,A123456(7)", "Mary,Smith,1987-01-02,mary@x.com,B7654321"
SOURCES = {
    "alpha_lead": ["lead_id,first,last,dob,email,gov", f"L1,{JOHN}", "L2,Ann,Lee,1990-01-01,N/A,K9876543", "L3,Bo,Ng,,bo@x.com,"],
    "alpha_quote": ["quote_id,lead_id,region,number", "Q1,L1,HK,1", "Q2,,HK,2", "Q3,L9,SG,1"],
    "alpha_quote_member": ["member_id,quote_id,kind,first,last,dob,email,gov", f"M1,Q1,Primary,{JOHN}", f"M2,Q1,Spouse,{MARY}", "M3,Q2,Child,王,小明,2015-05-05,,"],
    "alpha_application": ["app_id,region,number," + ",".join(f"{r}_{c}" for r in ("applicant", "spouse") for c, _ in PERSON), f"A1,HK,1,{JOHN},{MARY}", "A2,HK,2,Ann,Lee,1990-01-01,,C111111(1),,,,,", "A3,,2,,,,,,,,,,"],
    "alpha_contact_person": ["contact_id,first,last,dob,email,gov", "C1,Bo,Ng,,bo@x.com,"],
    "alpha_lead_contact": ["lead_id,contact_id", "L3,C1"],
}
DELTA = {"alpha_lead": ["lead_id,first,last,dob,email,gov,is_deleted", "L2,Ann,Leigh,,ann@x.com,K9876543,False", "L4,Cy,Oh,2000-01-01,cy@x.com,"], "alpha_quote": ["quote_id,lead_id,region,number", "Q1,L4,HK,1"]}


def write(folder, tables, headers=None):
    folder.mkdir(parents=True, exist_ok=True)
    for name, lines in tables.items():
        head = [",".join(c.split()[0] for c in METADATA[name].split(", "))] if headers else []
        (folder / f"{name}.csv").write_text("\n".join([*head, *lines]) + "\n", encoding="utf-8")


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    top = tmp_path_factory.mktemp("run")
    write(top / "metadata", CONTROL | {"metadata_column": columns()}, True)
    write(top / "full", SOURCES)
    write(top / "delta", DELTA)
    return top


@pytest.fixture(scope="module")
def full(spark, folders):
    run = Run(spark, str(folders / "metadata"), Sources(spark, str(folders / "full")), datetime(2026, 1, 1))
    run.run()
    run.save(str(folders / "out"))
    return run


def ids(frame, column):
    return sorted(r[0] for r in frame.select(column).collect())


def test_patterns_and_lookups(spark, folders):
    meta = Metadata.load(spark, str(folders / "metadata"))
    assert meta.is_conditional("Alpha", "quote_member") and not meta.is_column_subset("Alpha", "quote_member")
    assert meta.is_column_subset("Alpha", "application") and not meta.is_column_subset("Alpha", "lead")
    assert meta.primary_key("Alpha", "lead") == "lead_id"
    assert meta.resolve_column("C_LEAD_ID") == ("Alpha", "lead", "lead_id") and meta.resolve_column(None) == (None, None, None)
    assert meta.party_type_name(meta.party_type_id("a.lead")) == "a.lead"
    for ask in (lambda: meta.table("Gamma", "x"), lambda: meta.table("Alpha", "x"), lambda: meta.party_type_id("x"), lambda: meta.party_type_name("x"), lambda: meta.resolve_column("x"), lambda: meta.primary_key("Beta", "x")):
        with pytest.raises(ValueError):
            ask()


def test_bronze(full):
    parties = ids(full.state["source_party"], "source_party_id")
    assert parties == sorted(["SP_Alpha_lead_L1", "SP_Alpha_lead_L2", "SP_Alpha_lead_L3", "SP_Alpha_quote_Q1", "SP_Alpha_quote_Q2", "SP_Alpha_quote_Q3", "SP_Alpha_quote_member_M1", "SP_Alpha_quote_member_M2", "SP_Alpha_quote_member_M3", "SP_Alpha_application_A1_applicant", "SP_Alpha_application_A1_spouse", "SP_Alpha_application_A2_applicant", "SP_Alpha_contact_person_C1"])
    edges = {(r.from_party_id[9:], r.to_party_id[9:], r.metadata_relationship_id or r.metadata_party_type_relationship_id) for r in full.state["relationship"].collect()}
    assert edges == {
        ("quote_member_M1", "quote_Q1", "R_MEMBER"), ("quote_member_M2", "quote_Q1", "R_MEMBER"), ("quote_member_M3", "quote_Q2", "R_MEMBER"), ("quote_Q1", "lead_L1", "R_QUOTE"),
        ("application_A1_applicant", "quote_Q1", "R_APP"), ("application_A2_applicant", "quote_Q2", "R_APP"), ("lead_L3", "contact_person_C1", "R_CONTACT"),
        ("application_A1_applicant", "application_A1_spouse", "PTR"), ("application_A1_spouse", "application_A1_applicant", "PTR"),
    }
    composite = full.state["relationship"].filter("metadata_relationship_id = 'R_APP'").first()
    assert composite.from_matching_value.startswith("HK|")


def test_silver_and_gold(full):
    attrs = {(r.party_id[9:], r.subtype): r.value for r in full.attributes().collect()}
    assert attrs["lead_L2", "SUB_HKID"] == "K987654(3)" and attrs["quote_member_M2", "SUB_HKID"] == "B765432(1)"
    assert ("lead_L2", "ATTR_EMAIL") not in attrs and attrs["quote_member_M3", "ATTR_FIRST_NAME"] == "王"
    links = {r.party_id[9:]: r for r in full.state["party_to_entity_link"].collect()}
    john = {links[p].master_entity_id for p in ("lead_L1", "quote_member_M1", "application_A1_applicant")}
    assert len(john) == 1 and links["lead_L1"].confidence_tier == "HIGH"
    assert links["quote_member_M2"].master_entity_id == links["application_A1_spouse"].master_entity_id not in john
    assert links["lead_L2"].master_entity_id != links["application_A2_applicant"].master_entity_id
    assert links["lead_L3"].link_type == "SINGLETON"


def test_reads_and_views(spark, full, folders):
    t = Catalogue(spark, str(folders / "metadata"), str(folders / "out/bronze"), str(folders / "out/silver"), str(folders / "out/gold"))
    listed = reads.parties(t.tables)
    assert listed.count() == 13
    found = {r.party_id: r for r in listed.collect()}
    assert found["SP_Alpha_lead_L1"].display_name == "JOHN SMITH" and found["SP_Alpha_lead_L1"].match_score == 1.0
    assert found["SP_Alpha_quote_Q1"].entity_id is None and found["SP_Alpha_lead_L3"].match_score == 1.0
    ents = reads.entities(t.tables)
    first = views.sort_by(ents, "party_count", True, views.ENTITY_SORTS).first()
    assert (first.primary_name, first.party_count, first.source_systems) == ("JOHN SMITH", 3, ["Alpha"])
    assert ents.filter("party_count = 1 and avg_pair_score is not null").isEmpty()
    with pytest.raises(ValueError):
        views.sort_by(ents, "nothing")
    for missing in (lambda: reads.entity_detail(t.tables, "x"), lambda: reads.party_detail(t.tables, "x"), lambda: reads.cluster_detail(t.tables, "x"), lambda: reads.party_context(t.tables, "x")):
        with pytest.raises(reads.NotFound):
            missing()
    context = reads.party_context(t.tables, "SP_Alpha_lead_L1")
    assert {r.party_id for r in context["parties"].collect() if r.in_entity} == {"SP_Alpha_lead_L1", "SP_Alpha_quote_member_M1", "SP_Alpha_application_A1_applicant"}
    assert [r.party_id for r in context["parties"].collect() if r.is_focus] == ["SP_Alpha_lead_L1"]
    assert len(reads.party_detail(t.tables, "SP_Alpha_lead_L1").first().attributes) == 5
    detail = reads.entity_detail(t.tables, first.entity_id)
    assert detail["match_evidence"].filter("match_score <> 1.0").isEmpty() and detail["parties"].count() == 3
    assert [r.entity_id for r in reads.search(t.tables, "JOHN@").collect()] == [first.entity_id]
    assert reads.search(t.tables, "").isEmpty()
    assert reads.dashboard(t.tables)["totals"].first().unique_attribute_types == 5
    assert {r.system_name for r in reads.source_systems(t.tables, context["parties"]).collect()} == {"Alpha"}
    assert reads.health(spark).first().status == "healthy" and reads.configs(spark).filter("is_active").first().config == "default"
    assert reads.as_json(ents).first().json.startswith("{")
    assert reads.steward_tiers(spark).count() == 1 and reads.steward_review(spark).isEmpty()
    side = views.compare_pair(full.attributes(), "SP_Alpha_lead_L1", "SP_Alpha_lead_L2").collect()
    assert [r.status for r in side] == sorted((r.status for r in side), key=["match", "mismatch", "missing"].index)
    assert views.filter_parties(listed, search="SMITH", has_entity=True).count() == 5
    assert views.party_rows(listed, reads.attributes_with_lineage(t.tables), search="smith").count() == 5
    assert views.entity_facets(listed).first().source_systems == ["Alpha"]
    assert views.filter_entities(ents, conflicts=False, max_parties=2).count() == ents.count() - 1


def test_delta_run(spark, full, folders):
    state = load_state(spark, str(folders / "out"))
    run = Run(spark, str(folders / "metadata"), Sources(spark, str(folders / "full"), str(folders / "delta")), datetime(2026, 2, 1), profiles.ANALYTICS, state)
    write(folders / "full", {"alpha_lead": [*SOURCES["alpha_lead"], "L4,Cy,Oh,2000-01-01,cy@x.com,"]})
    run.run(split_conflicts=True)
    assert run.state["source_party"].count() == 14
    versions = {(r.raw_attribute_id.split("_lead_")[1], r.raw_value, r.rec_end_date is None) for r in run.state["raw_attribute"].filter("source_party_id = 'SP_Alpha_lead_L2'").collect()}
    assert {("L2_C_LEAD_last@a.lead", "Lee", False), ("L2_C_LEAD_last@a.lead_v2", "Leigh", True), ("L2_C_LEAD_dob@a.lead", "1990-01-01", False), ("L2_C_LEAD_email@a.lead", "ann@x.com", True)} <= versions
    edges = {(r.from_party_id[9:], r.to_party_id[9:]): r.rec_end_date is None for r in run.state["relationship"].collect()}
    assert edges["quote_Q1", "lead_L1"] is False and edges["quote_Q1", "lead_L4"] is True and edges["lead_L3", "contact_person_C1"] is True
    now = {r.party_id[9:]: r.cluster_id for r in run.state["party_cluster"].filter("rec_end_date is null").collect()}
    before = {r.party_id[9:]: r.cluster_id for r in full.state["party_cluster"].collect()}
    assert now["quote_Q1"] == before["quote_Q1"] == now["lead_L4"] and now["lead_L1"] != before["lead_L1"]
    assert now["contact_person_C1"] == before["contact_person_C1"]


def test_reads_over_http(spark, full, folders):
    c = Catalogue(spark, str(folders / "metadata"), str(folders / "out/bronze"), str(folders / "out/silver"), str(folders / "out/gold"))
    server = serve(Service(spark, c), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode() if body else None)
        with urllib.request.urlopen(request) as reply:
            return json.load(reply)

    try:
        assert ask("/api/health") == [{"status": "healthy", "config": "default"}]
        assert len(ask("/api/parties")) == 13
        big = max(ask("/api/entities"), key=lambda e: e["party_count"])
        detail = ask(f"/api/entities/{big['entity_id']}")
        assert set(detail) == {"entity", "parties", "match_evidence", "blocking", "relationships"} and len(detail["parties"]) == big["party_count"]
        assert ask("/api/parties/SP_Alpha_lead_L1")[0]["party_id"] == "SP_Alpha_lead_L1"
        assert ask("/api/search?q=JOHN%40")[0]["entity_id"] == big["entity_id"]
        assert ask("/api/dashboard/stats")["totals"][0]["total_parties"] == 13
        assert [r["config"] for r in ask("/api/config", {"config": "analytics"}) if r["is_active"]] == ["analytics"]
        for path, body, status in (("/api/entities/none", None, 404), ("/api/nothing", None, 404), ("/api/config", {"config": "none"}, 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                ask(path, body)
            assert e.value.code == status
    finally:
        server.shutdown()
