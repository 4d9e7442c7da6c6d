from lodesieve.sources import feeds


def write(tmp_path, name, content, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(content.encode(encoding))
    return str(p)


def test_positional_short_rows_and_missing_marks(spark, tmp_path):
    p = write(tmp_path, "sdn.csv", '1,"PÉREZ, A",-0- ,CUBA\n\n2,"X",individual,"P","t"\n', "iso-8859-1")
    rows = {r.ent_num: r for r in feeds.list_entities(spark, p, "sdn").collect()}
    assert rows[1].name == "PÉREZ, A" and rows[1].sdn_type is None and rows[1].remarks is None and rows[2].title == "t" and len(rows) == 2


def test_preamble_and_columns_by_any_writing(spark, tmp_path):
    p = write(tmp_path, "ofsi.csv", '﻿Last Updated,13/06/2026\nName 6,NAME 1,Group ID,group  type,Regime Name,Address Country\n"SMITH","John","12","Individual","Iran","UK"\n,,,,,\n')
    r = feeds.ofsi_entries(spark, p).collect()
    assert [(x.name, x.group_id, x.group_type, x.regime, x.country) for x in r] == [("John SMITH", "12", "Individual", "Iran", "UK")]


def test_targets(spark, tmp_path):
    p = write(tmp_path, "t.csv", 'id,schema,name,aliases,identifiers\nw1,CryptoWallet,0xA,"; a;;b ","XBT;q"\np1,Person,,,\n')
    t = feeds.targets_csv(spark, p, "crypto")
    assert [(x.aliases, x.countries) for x in t.where("entity_id = 'w1'").collect()] == [(["a", "b"], [])]
    assert [(x.address, x.currency, x.entity_ref) for x in feeds.target_wallets(t).collect()] == [("0xA", "XBT", "w1")]


def test_xml(spark, tmp_path):
    p = write(tmp_path, "e.xml", """<?xml version="1.0"?><root><entities>
<entity id="7"><generalInfo><entityType>Entity</entityType></generalInfo><sanctionsPrograms><sanctionsProgram>A</sanctionsProgram><sanctionsProgram>B</sanctionsProgram></sanctionsPrograms>
<names><name><translations><translation><formattedFullName>ACME</formattedFullName></translation></translations></name></names>
<features><feature><type>Digital Currency Address - XBT</type><value>1abc</value></feature><feature><type>Website</type><value>x</value></feature></features></entity></entities></root>""")
    e = feeds.enhanced_entities(spark, p)
    r = e.first()
    assert (r.entity_id, r.name, r.programs) == ("7", "ACME", ["A", "B"])
    assert [tuple(x) for x in feeds.enhanced_wallets(e).collect()] == [("7", "1abc", "XBT")]


def test_un_xml(spark, tmp_path):
    p = write(tmp_path, "un.xml", """<L><INDIVIDUALS><INDIVIDUAL><DATAID>1</DATAID><FIRST_NAME>A</FIRST_NAME><SECOND_NAME>B</SECOND_NAME><UN_LIST_TYPE>QD</UN_LIST_TYPE><NATIONALITY><VALUE>Mali</VALUE></NATIONALITY>
<INDIVIDUAL_ALIAS><ALIAS_NAME>C</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_ALIAS><ALIAS_NAME></ALIAS_NAME></INDIVIDUAL_ALIAS></INDIVIDUAL></INDIVIDUALS>
<ENTITIES><ENTITY><DATAID>2</DATAID><FIRST_NAME>Firm</FIRST_NAME></ENTITY></ENTITIES></L>""")
    r = {x.un_id: x for x in feeds.un_records(spark, p).collect()}
    assert (r["1"].name, r["1"].record_type, r["1"].aliases, r["1"].nationalities) == ("A B", "individual", ["C"], ["Mali"])
    assert (r["2"].name, r["2"].record_type) == ("Firm", "entity")


def test_pattern_hits_and_lines(spark, tmp_path):
    p = write(tmp_path, "a.txt", "h\n0xaa 0xbb\n0xaa\n")
    assert {tuple(r) for r in feeds.pattern_hits(spark, p, "0x[a-z]+").collect()} == {("0xaa", 2), ("0xbb", 1)}
    assert feeds.line_count(spark, p) == 2
    assert len(feeds.FEEDS) == 10
