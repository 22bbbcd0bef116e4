import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from skein.sources import chats, mail, media, sinks, tables


def put(path, name, text):
    f = path / name
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_text(text if isinstance(text, str) else json.dumps(text))
    return f


def test_chat_json(spark, tmp_path):
    put(tmp_path, "inbox/bo_1/message_1.json", {"participants": [{"name": "Bo"}, {"name": "Me"}], "messages": [{"sender_name": "Bo", "timestamp_ms": 20, "content": "CafÃ©"}, {"sender_name": "Me", "timestamp_ms": 10, "photos": [{"uri": "x"}]}]})
    got = chats.chat_json(spark, f"{tmp_path}/inbox/*/message_*.json", "ig:", "Me").orderBy("ts").collect()
    assert [(r["id"], r["body"], r["attachment_type"], r["from_me"], r["is_group"]) for r in got] == [("ig:bo_1#0", "", "image", True, False), ("ig:bo_1#1", "Café", None, False, False)]


def test_export_union_and_tail(spark):
    s = "export string, thread_id string, ts long, sender_name string, body string, attachment_type string"
    df = spark.createDataFrame([("a", "t", 1, "Bo", "x", None), ("a", "t", 1, "Bo", "x", None), ("b", "t", 1, "Bo", "x", None), ("b", "t", 2, "Cy", "y", None)], s)
    got = chats.merge_exports(df, "fb:", "Me").orderBy("id").collect()
    assert [(r["id"], r["body"]) for r in got] == [("fb:t#0", "x"), ("fb:t#1", "x"), ("fb:t#2", "y")] and got[0]["participants"] == ["Bo", "Cy"] and got[0]["is_group"]
    m = "thread_id string, ts long, body string"
    base, new = spark.createDataFrame([("t", 5, "a")], m), spark.createDataFrame([("t", 5, "b"), ("t", 6, "c"), ("u", 1, "d")], m)
    assert sorted(r["body"] for r in tables.tail_merge(base, new).collect()) == ["a", "c", "d"]


def test_text_exports(spark, tmp_path):
    put(tmp_path, "im/Bo.txt", "Jan 05, 2024  9:01:02 PM\nMe\nhello\n\nJan 06, 2024 10:00:00 AM\nBo\nTapback x\n\nJan 06, 2024 10:00:00 AM\nBo\nAttachments/a.jpg\n")
    got = chats.text_blocks(spark, f"{tmp_path}/im/*.txt").orderBy("ts").collect()
    assert [(r["body"], r["from_me"], r["attachment_type"]) for r in got] == [("hello", True, None), ("Attachments/a.jpg", False, "image")]
    put(tmp_path, "wa/Group.txt", "[05/01/2024, 21:01:02] Bo: one\ntwo\n06/01/24, 10:00 - Cy: image omitted\n")
    got = chats.chat_lines(spark, f"{tmp_path}/wa/*.txt").orderBy("ts").collect()
    assert [(r["id"], r["sender_name"], r["body"], r["attachment_type"]) for r in got] == [("wa:Group#0", "Bo", "one\ntwo", None), ("wa:Group#1", "Cy", "image omitted", "media")]
    assert got[0]["ts"] == 1_704_488_462_000


def test_spool(spark, tmp_path):
    line = lambda i, ts, msg, kind="upsert", jid="a@s": json.dumps({"kind": kind, "message": {"key": {"remoteJid": jid, "id": i, "fromMe": False}, "messageTimestamp": ts, "pushName": "Bo", "message": msg}})
    put(tmp_path, "s/d1.jsonl", "\n".join([line("1", "5", {"conversation": "old"}), line("2", "15", {"extendedTextMessage": {"text": "new"}}), line("2", "15", {"conversation": "again"}), line("3", "16", {"conversation": "x"}, "receipt"), line("4", "17", {"conversation": "s"}, jid="status@broadcast"), line("5", "18", {"ephemeralMessage": {"message": {"conversation": "eph"}}})]))
    floors = spark.createDataFrame([("wai:a@s", 10_000)], "thread_id string, floor long")
    got = chats.spool(spark, f"{tmp_path}/s", floors).orderBy("ts").collect()
    assert [r["id"] for r in got] == ["wai:a@s#2", "wai:a@s#5"] and got[1]["body"] == "eph"
    put(tmp_path, "s/d2.jsonl", "{broken")
    assert chats.spool(spark, f"{tmp_path}/s", floors, strict=False).count() == 2
    try:
        chats.spool(spark, f"{tmp_path}/s", floors).count()
        raise AssertionError("a malformed line must be fatal")
    except Exception as e:
        assert "MALFORMED" in str(e).upper()


def test_html_thread(spark, tmp_path):
    block = '<div id=x class="pam _3-95 _2ph- _a6-g uiBoxWhite noborder"><h2 class="y">{}</h2><div class="_3-95 _a6-p"><div>{}</div></div><div class="_3-94 _a6-o">{}</div></div>'
    head = '<h1>Bo &amp; Co</h1>Contains data you requested from <time datetime="2024-01-05T12:00:00Z">Jan 5, 2024 2:00 pm</time><script>"<div class=\'_a6-g\'>"</script>'
    messages = block.format("Bo &amp; Co", "hi <b>you<i></b> &#x1F44D;&hellip;<br>there", "Jan 05, 2024 2:30 pm") + block.format("Me", '<a href="u"><img src="a.png"></a>', "January 6, 2024 at 12:05 AM") + block.format("Me", "no time", "soon")
    put(tmp_path, "h/bo/message_1.html", f"<html><body>{head}{messages}</body>")
    got = sorted((r["ts"], r["sender_name"], r["body"], r["attachment_type"], r["thread_id"]) for r in chats.chat_html(spark, f"{tmp_path}/h/*/*.html").collect())
    assert got == [(1_704_457_800_000, "Bo & Co", "hi you 👍… there", None, "bo"), (1_704_492_300_000, "Me", "", "image", "bo")]


def test_mailbox(spark, tmp_path):
    mbox = "From a@b Thu\nFrom: Bo <bo@x.y>\nTo: me@x.y\nMessage-ID: <1>\nX-GM-THRID: 1000\nDate: Fri, 05 Jan 2024 12:00:00 +0000\n\nhello\nFrom a@b Thu\nFrom: Me <me@x.y>\nTo: bo@x.y\nMessage-ID: <2>\nX-GM-THRID: 1000\nIn-Reply-To: <1>\n\nback\nFrom a@b Thu\nFrom: News <news@z.y>\nMessage-ID: <3>\nList-Unsubscribe: <x>\nX-Gmail-Labels: Inbox,Category Promotions\nDate: Fri, 05 Jan 2024 12:00:00 +0000\n\nbuy\nFrom a@b Thu\nFrom: no-reply@q.y\nMessage-ID: <4>\n\nauto\nFrom a@b Thu\nFrom: s@q.y\nX-Gmail-Labels: Spam\n\nbad\n"
    put(tmp_path, "a.mbox", mbox)
    m = mail.mbox(spark, f"{tmp_path}/*.mbox")
    assert sorted(r["kind"] for r in m.collect()) == ["automated", "bulk", "human", "human"]
    t = mail.mail_threads(m, ["me@x.y"]).first()
    assert (t["thread_id"], t["messages"], t["participants"]) == ("gmail:1000", 2, ["bo@x.y"])
    c = {r["addr"]: r for r in mail.bulk_correspondents(m).collect()}
    assert c["news@z.y"]["kind"] == "bulk" and c["news@z.y"]["top_labels"] == ["Inbox", "Category Promotions"] and c["no-reply@q.y"]["kind"] == "automated"


def test_cards(spark, tmp_path):
    put(tmp_path, "c.vcf", "BEGIN:VCARD\nFN:Ann Abel\nTEL;CELL:+1 555 010 0100\nEMAIL:Ann@X.Y\nBDAY:1604-03-02\nEND:VCARD\nBEGIN:VCARD\nN:Birch;Bob\nTEL:15550100100\nBDAY:1990-04-05\nEND:VCARD\n")
    contacts, days = mail.vcards(spark, f"{tmp_path}/*.vcf")
    assert {r["key"]: r["name"] for r in contacts.collect()} == {"+15550100100": "Ann Abel", "ann@x.y": "Ann Abel"}
    assert sorted((r["name"], r["month"], r["day"], r["year"], r["year_known"]) for r in days.collect()) == [("Ann Abel", 3, 2, None, False), ("Bob Birch", 4, 5, 1990, True)]
    put(tmp_path, "c.ics", "BEGIN:VEVENT\nSUMMARY:Ann Abel's Birthday\nDTSTART;VALUE=DATE:20240302\nEND:VEVENT\n")
    b = mail.ordered(days.unionByName(mail.ics_birthdays(spark, f"{tmp_path}/*.ics")))
    assert sorted((r["name"], r["source"]) for r in tables.birthday_precedence(b).collect()) == [("Ann Abel", "vcard"), ("Bob Birch", "vcard")]


def test_media(spark, tmp_path):
    put(tmp_path, "g/a.json", {"title": "a.jpg", "photoTakenTime": {"timestamp": "100"}, "geoData": {"latitude": 0.0, "longitude": 0.0}})
    put(tmp_path, "g/b.json", {"title": "b.jpg", "photoTakenTime": {"timestamp": "200"}, "geoData": {"latitude": 0.0, "longitude": 7.5}})
    got = {r["id"]: (r["ts"], r["lat"], r["lng"]) for r in media.sidecars(spark, f"{tmp_path}/g/*.json").collect()}
    assert got == {"gphotos:a.jpg@100": (100_000, None, None), "gphotos:b.jpg@200": (200_000, 0.0, 7.5)}
    e = spark.createDataFrame([("1", "Do", 10, 0, None, None, None, "declined", 0), ("1", "Do", 10, 20, "Hall", 1.0, 2.0, "joined", 1), (None, "No", 0, 0, None, None, None, "invited", 2)], "fbid string, name string, start_timestamp long, end_timestamp long, place_name string, lat double, lng double, response string, ordinal int")
    got = {r["event_key"]: (r["response"], r["start_ts"], r["end_ts"], r["place_name"]) for r in media.facebook_events(e).collect()}
    assert got == {"fb-1": ("joined", 10_000, 20_000, "Hall"), "no": ("invited", None, None, None)}
    put(tmp_path, "y.csv", 'Video ID,Title,Plays,Artist 1,Artist 2\nv1,"two\nlines ""q""",x,A,\n,,,,\nv2,t,5,,B\n')
    got = media.takeout_csv(spark, f"{tmp_path}/y.csv", {"id": "Video ID", "title": "Title", "plays": "Plays"}, ("plays",), {"artists": ["Artist 1", "Artist 2"]}).orderBy("id").collect()
    assert [(r["id"], r["title"], r["plays"], r["artists"]) for r in got] == [("v1", 'two\nlines "q"', None, ["A"]), ("v2", "t", 5, ["B"])]
    cell = '<div class="outer-cell mdl-cell"><div><p class="t">YouTube</p></div><div class="content">Watched&nbsp;<a target=_blank href="https://www.youtube.com/watch?v={}">{}</a><br>{}<br>{}<br></div></div>'
    channel = '<a href="https://www.youtube.com/channel/c1">Ch <b>an</b></a>'
    cells = [cell.format("abc", "A &amp; B", channel, "Jan 5, 2024, 2:00:00 PM GMT+02:00"), cell.format("d-_", "https://x", "", "13 January 2019, 19:37:22 GMT-0530"), cell.format("e", "E", channel, "5 Jan 2024, 12:00:00 UTC"), '<div class="outer-cell">Visited</div>']
    put(tmp_path, "h.html", f"<div>{''.join(cells)}</div>")
    got = [tuple(r) for r in media.watch_history(spark, f"{tmp_path}/h.html").collect()]
    assert got == [("abc", "A & B", "c1", "Ch an", 1_704_456_000_000), ("d-_", None, None, None, 1_547_428_042_000), ("e", "E", "c1", "Ch an", 1_704_456_000_000)]
    g = media.guest_list(spark.createDataFrame([("Hosted by Ann\nBob\nWhen\n12 Going\n3 Maybe\nGuest List\nCy\nD***\n",)], "text string")).first()
    assert (g["hosts"], g["going"], g["maybe"], g["guests"]) == (["Ann", "Bob"], 12, 3, ["Cy"])


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "c.db") as con:
        con.execute("create table z (id integer, d real)")
        con.executemany("insert into z values (?, ?)", [(1, 0.5), (2, None)])
    assert chats.sqlite_rows(spark, str(tmp_path / "c.db"), "select id, d from z", "id long, d double").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, source string")
    p = str(tmp_path / "t")
    sinks.insert_ignore(spark, df, p, ["id"])
    sinks.insert_ignore(spark, df.union(spark.createDataFrame([(3, "c")], "id long, source string")), p, ["id"])
    assert spark.read.parquet(p).count() == 3
    q = str(tmp_path / "q")
    sinks.overwrite(df, q, "source")
    sinks.overwrite(df.where("source = 'a'").withColumn("id", F.col("id") + 10), q, "source")
    assert sorted(r["id"] for r in spark.read.parquet(q).collect()) == [2, 11]
    root = tmp_path / "rel"
    root.mkdir()
    sinks.publish(df, str(root), "v1")
    try:
        sinks.publish(df.limit(0), str(root), "v2", gate=lambda m: m["rows"] > 0)
        raise AssertionError("the gate must refuse")
    except ValueError:
        pass
    assert sinks.current(spark, str(root)).count() == 2
    sinks.publish(df, str(root), "v3")
    assert sinks.prune(spark, str(root), 0) == ["v1"]


def test_references_without_semicolon_stay_text():
    from skein.sources.markup import MESSAGES, Records

    block = '<div class="_a6-g"><h2>{}</h2><div class="_a6-p"><a href="?a=1&copy=2">x &amp; y&ampz &lt</a><script>a && b &amp; c</script>{}</div></div>'
    r = Records(MESSAGES).read(block.format("A&amp;&amp", "&#33;&#33 &amp;lt;"))[0]
    assert "".join(r["fields"]["sender"]).strip() == "A&&amp" and r["links"][0][0] == "?a=1&copy=2"
    assert " ".join("".join(r["fields"]["body"]).split()) == "x & y&ampz &lt a && b &amp; c !&#33 &lt;"


def test_watched_titles_cut_within_a_reference(spark, tmp_path):
    cell = '<div class="outer-cell">Watched <a href="https://y.example/watch?v=k">R &amp;&ampamp; D&amp</a> 5 Jan 2024, 12:00:00 UTC</div>'
    put(tmp_path, "w.html", f"<html>{cell}</html>")
    assert [r["title"] for r in media.watch_history(spark, str(tmp_path)).collect()] == ["R &&ampamp; D&amp"]


def test_small_threads_are_one_file_each(spark, monkeypatch):
    import glob
    import os

    import pytest

    from skein.plans.catalog import QUERIES

    sf, found, read = "/root/testdata/sf0.001", [], chats.chat_json
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    monkeypatch.setattr(chats, "chat_json", lambda s, path, *a: (found.append(path), read(s, path, *a))[1])
    assert QUERIES["q_s01_s04_chat_json"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    files = glob.glob(found[0].removeprefix("file://"))
    assert len(files) == len({os.path.dirname(f) for f in files}) > 1


def test_attachments_of_archives_and_folders_are_alike(spark, tmp_path):
    import hashlib

    from skein.plans.q_sources import tar_member

    texts = ["", "a", "é" * 300, "x" * 511, "x" * 512, "y\n\0z", "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    rows.select(tar_member(F.concat(F.lit("f"), F.col("i").cast("string"), F.lit(".JPG")), F.col("t")).alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 3).text(f"{tmp_path}/tars")
    (tmp_path / "files" / "deep").mkdir(parents=True)
    for i, t in enumerate(texts):
        (tmp_path / "files" / "deep" / f"f{i}.JPG").write_bytes(t.encode())
    (tmp_path / "files" / "note.txt").write_text("no image")
    want = sorted({(hashlib.sha256(t.encode()).hexdigest(), len(t.encode())) for t in texts})
    for at, archives in (("tars", True), ("files", False)):
        got = media.attachments(spark, f"{tmp_path}/{at}", archives=archives)
        found = sorted(map(tuple, got.select("hash_sha256", "length").collect()))
        assert found == (want if archives else [w for w in want if w[1]])  # the reader of folders passes over empty files


def test_attachment_texts_are_not_a_file_each(spark):
    import os

    from skein.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    got = QUERIES["q_s21_attachment_images"](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0 < len(got.inputFiles()) < n // 50


def test_a_history_page_is_read_in_pieces(spark, tmp_path):
    # a page was one row of one task, whatever its size
    from skein.sources import markup

    cell = '<div class="outer-cell"><div>Watched <a href="https://y.example/watch?v=v{0}">T &amp R{0}</a><br><script>var a = "<div class=outer-cell>&";</script><p>left open<div>5 Jan 2024, 12:00:00 GMT+02:00</div></div></div>'
    page = "<html><style>div < p</style><DIV><body>" + "".join(cell.format(k) for k in range(300)) + '<div id=x class="a outer-cell"><a href="watch?v=z">Z</a></body><div class="outer-cell"><a href="/watch?v=w">W<script>never &lt; closed <div class="outer-cell">'
    pieces = ["<div" * bool(n) + x for n, x in enumerate(page.split("<div"))]
    want = markup.Records(markup.ACTIVITY).read(page)
    reader, most, got = markup.Records(markup.ACTIVITY), 0, []
    for r in reader.stream(pieces):
        got.append(r)
        most = max(most, len(reader.records))
    told = lambda rs: [(["".join(t) for _, t in r["links"]], [h for h, _ in r["links"]], "".join(r["text"])) for r in rs]
    assert told(got) == told(want) and len(want) > 300 and most <= 1
    (tmp_path / "h.html").write_text(page)
    out = [tuple(r) for r in media.watch_history(spark, f"{tmp_path}/*.html").collect()]
    assert out[:2] == [("v0", "T &amp R0", None, None, 1704448800000), ("v1", "T &amp R1", None, None, 1704448800000)] and {"z", "w"} <= {r[0] for r in out}
