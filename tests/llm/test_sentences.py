import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.functions.identifiers import WS_CHARS
from marginalia.llm.sentences import Abbreviations, sentence_ends, sentences


def cut_up(text):
    solid = [i for i, c in enumerate(text) if c not in WS_CHARS]
    ends = sentence_ends(text)
    return [text[solid[a] : solid[b - 1] + 1] for a, b in zip([0, *ends], ends)]


CASES = [
    ["See Sec. 59.58 and Fig. 366 for the rotor.", "It weighs 3.9 kg max. and reads 38 rpm per hr. at most."],
    ["Use a tray, e.g. the Tredan tracker, with care.", "Is \"Where is the mailbox?\" still shown on the panel?", "Yes!"],
    ["On restart the socket prints \"FAU8459A.\"", "Run niagun.conf at 3:20 p.m., then stop."],
    ["“Never loosen the cap. It measures the record.”", "The queue merges the tracker, the magazine, etc.", "Neither moves."],
    ["It holds a volume, etc. and a ledger in nobrian.cfg.", "kaipais.rc holds v116.18 files!"],
    ["Keep it at or below 153.", "Wait ... then purge the rotor.", "It fails …", "On restart it stops."],
    ["(The upper mirror balances the plate of STAIVIT only once.)", "Parts of Kokracot Inc. Model 149 feed it."],
    ["Ab dem 570. Start ist die Kassette d. h. die Anzeige zu prüfen.", "Die Steuerung kopiert z. B. die Datei usw.", "Steht „Sie sperrt. Bitte lösen!“ auf der Tafel, so endet es."],
    ["La console affiche « La buse charge. Il faut relancer ! » et bloque.", "Ne jamais serrer la trappe !", "Voir fig. 12, p. ex. la vanne."],
    ["画面に「応答しません。点検します。」と表示されたら、停止します。", "なぜ遅れるのか？！", "図76.8のとおり、部品（型番A1。旧型は無し。）を横で切り離します。", "入力が…まで届かないときは待ちます。"],
    ["说明书写道：“先断开电源板。再更换。”", "屏幕显示“无响应。请清洁！”时，请停止。", "“在哪里？”是提示，并非故障。", "它会测量……并更换。"],
    ["पैनल पर \"मोटर रुका है। साफ़ करें।\" दिखे तो रुकें।", "GUWIAT को 31.98 मि.मी. पर रखें।"],
    ["هل الخزان أسخن بمقدار 58.7 درجة؟", "تعرض الشاشة «متوقف. افحص!» عندما يعمل.", "شغّل المحرك."],
    ["ปิดวาล์วก่อนถอดพัดลม", "ตั้งค่า GOKAIX เป็น 32.46 แล้วปิดวาล์ว", "ตรวจสอบ"],
]


@pytest.mark.parametrize("want", CASES)
def test_scripts(want):
    assert cut_up(" ".join(want)) == want
    assert cut_up("\r\n".join(want)) == ["\r\n".join([x]) for x in want]


def test_blocks_lists_and_missing_blanks():
    text = "Starting the pump\r\n \r\nTo stop\r\nit, pull.\n\n1) first. item\n2) second item\n\n* bullet\n\nIt ends here.The next one.Is it?"
    assert cut_up(text) == ["Starting the pump", "To stop\r\nit, pull.", "1) first. item", "2) second item", "* bullet", "It ends here.", "The next one.", "Is it?"]


def test_open_quotes_do_not_swallow():
    assert cut_up("He said “stop. Then he left. It rained.") == ["He said “stop.", "Then he left.", "It rained."]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 .!?…。「」“”\"()\n\rก　,", max_size=80))
def test_every_character_belongs_to_a_sentence(text):
    ends = sentence_ends(text)
    n = sum(c not in WS_CHARS for c in text)
    assert (ends == [] and n == 0) or (ends[-1] == n and ends == sorted(set(ends)) and ends[0] > 0)


def test_table(spark):
    rows = [(1, "One. Two.", "x"), (2, None, "x"), (3, " \n", "x"), (4, "", "x"), (5, "A. " * 5 + "word " * 100_000, "x")]
    got = sentences(spark.createDataFrame(rows, "id bigint, text string, end_pos string")).collect()
    assert {(r.id, r.end_pos) for r in got if r.id == 1} == {(1, 4), (1, 8)} and {r.id for r in got} == {1, 5}
    assert sentences(spark.createDataFrame([], "id bigint, text string"), True).count() == 0


def test_abbreviations_are_a_parameter():
    text = "The approx. Value of the zzq. Unit is low. No. 5 is no. That ends."
    default, own = sentence_ends(text), sentence_ends(text, Abbreviations(never=["zzq"]))
    ends = {len(x.replace(" ", "")) for x in ("The approx. Value of the zzq.", "The approx. Value of the zzq. Unit is low.", text[: text.index(" That")], text)}
    assert set(default) == ends
    assert len("Theapprox.") in own and len("Theapprox.Valueofthezzq.") not in own
