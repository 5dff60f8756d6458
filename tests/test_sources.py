import datetime as dt
import io
import zipfile

import pytest

from oxyframe.errors import SignalError, SignalWarning
from oxyframe.functions import palette, timefmt
from oxyframe.functions.windows import snapped
from oxyframe.plans import catalog
from oxyframe.sources import devices, recording, tables, timeparse


def test_example(spark, tmp_path):
    path = tmp_path / "ramp.csv"
    path.write_bytes(recording.example("ramp"))
    sf = recording.read_recording(spark, str(path), verbose=False)
    assert sf.meta.device == "Moxy" and sf.meta.channels == ("SmO2 Live",) and sf.meta.sample_rate == 0.5
    got = sf.collect()
    assert got["hh:mm:ss"][:3] == [0.0, 2.0, 4.0] and got["SmO2 Live"][:2] == [70.0, 69.0]
    assert recording.example() == ["ramp.csv", "intervals.csv"]


def test_many_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_bytes(recording.example("ramp"))
    sf = recording.read_recordings(spark, str(tmp_path), {"smo2": "SmO2 Live"}, {"time": "hh:mm:ss"}, {"lap": "Lap"})
    assert sf.names() == ["f0", "f1", "f2"] and sf.df.count() == 360


def test_many_files_with_all_options(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_bytes(recording.example("ramp"))
    sf = recording.read_recordings(spark, str(tmp_path), event_channel={"lap": "Lap"}, add_timestamp=True, keep_all=True, describe=True)
    row = sf.df.orderBy("series", "_i").first()
    assert sf.meta.channels == ("SmO2 Live",) and row.device == "Moxy" and row.rate == 0.5 and row.others["THb"].startswith("12") and row.timestamp is not None
    assert sf.estimated_rate() == 0.5


def test_quoted_decimal_commas_and_names():
    body = b'Time[s],Time[hh:mm:ss],SmO2[%],SmO2 -  2[%]\n1,00:00:01,"0,00","40,90"\n2,00:00:02,"13,80",\n3,00:00:03,"x","1"\n'
    rows = tables.cells(body, "a.csv")
    assert devices.detect(rows) == ("VO2master", 0)
    p = recording.parse(rows, verbose=False)
    assert p.columns["SmO2[%]"] == [0.0, 13.8, None] and p.columns["SmO2 -  2[%]"] == [40.9, None, 1.0]
    p = recording.parse(rows, {"a": "SmO2[%]"}, {"t": "Time[s]"}, verbose=False)
    assert list(p.columns) == ["t", "a"] and p.rate == 1.0


def test_duplicate_headings():
    body = b"Timestamp (seconds passed),Lap/Event,SmO2,SmO2\n10.1,,50,60\n10.2,1,51,61\n10.3,,52,62\n"
    with pytest.warns(SignalWarning, match="duplicate channel names"):
        p = recording.parse(tables.cells(body, "a.csv"), ["SmO2", "SmO2"], event_channel={"lap": "Lap/Event"})
    assert p.channels == ["SmO2", "SmO2_1"] and p.columns["lap"] == [None, 1, None] and p.rate == 10.0


def test_numbered_headings():
    body = "Oxysoft export\nExport sample rate\t10\n1\t2\t3\n0\t5\t6\n1\t7\t8\n2\t9\t9\n".encode()
    rows = tables.cells(body, "a.txt")
    assert devices.detect(rows) == ("Artinis", 2)
    p = recording.parse(rows, {"o2hb": "2"}, verbose=False)
    assert p.time == "time" and p.columns["time"] == [0.0, 0.1, 0.2] and p.rate == 10


def test_spreadsheet():
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>SmO2 (1)</t></is></c></row><row r="3"><c r="A3"><v>0.5</v></c><c r="C3"><v>61</v></c></row></sheetData></worksheet>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Time</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert tables.cells(buf.getvalue(), "a.xlsx") == [["Time", None, "SmO2 (1)"], [None] * 3, ["0.5", None, "61"]]


def test_times():
    day = dt.date(2024, 1, 2)
    assert timeparse.seconds(["0.5", "0.50001"], None, False, day)[0] == [0.0, pytest.approx(0.864)]
    out, moments, start = timeparse.seconds(["2024-01-01T10:00:00.5Z", "2024-01-01 10:00:02"], None, False, day)
    assert out == [0.0, 1.5] and start == dt.datetime(2024, 1, 1, 10, 0, 0, 500000)
    assert timeparse.seconds(["5", "7"], None, True, day)[0] == [0.0, 2.0]
    assert timeparse.seconds(["5", "7"], dt.datetime(2024, 1, 1), False, day)[1][0] == dt.datetime(2024, 1, 1, 0, 0, 5)


def test_moments_as_strptime_takes_them():
    day = dt.date(2024, 1, 2)
    texts = ["1:2:3.5", "01:02:03", "23:59:59.1234567", "24:00:00", "12:60:00", "12:00:60", "12:00", "", "x", " 7:08:09 ", "2024-01-02T03:04:05", "2024-01-02t03:04:05.25", "2024-1-2  3:4:5.5", "2024-02-30 01:02:03", "0000-01-01 01:02:03",
             "2024/01/02 03:04:05", "2-1-2024 03:04:05", " 2/1/2024 03:04:05", "31/12/2024 23:59:59", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5-0130", "2024-01-02T03:04:05.5+25:00", "2024-01-02 03:04:05 x", "\u0661:02:03.5"]

    def plain(text, formats):
        for f in formats:
            for fraction in ("", ".0"):
                cut = text[: text.rindex(".") + 7] if text == "23:59:59.1234567" else text
                zone = next((z for z in ("+02:00", "Z") if fraction and cut.endswith(z)), "")
                try:
                    v = dt.datetime.strptime(cut.strip().removesuffix(zone) + fraction + zone, f)
                except ValueError:
                    continue
                v = dt.datetime.combine(day, v.time()) if f == timeparse.FORMATS[0] else v
                return v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
        return None

    for formats in (timeparse.FORMATS, timeparse.FORMATS[1:], timeparse.FORMATS[:1]):
        assert [timeparse.moment(t, formats, day) for t in texts] == [plain(t, formats) for t in texts]


def test_files_are_not_dealt_out_line_by_line(spark):
    for query in (catalog.read_times_of_day, catalog.read_repeated_headings, catalog.read_decimal_commas):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan


def test_short_files_go_on_together(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_bytes(recording.example("ramp"))
    files = recording._load(spark, str(tmp_path)).coalesce(1)
    df = recording.parse_recordings(files, {"smo2": "SmO2 Live"}, {"time": "hh:mm:ss"}).df
    sizes = df.mapInArrow(lambda batches: (b.slice(0, 0) if not b.num_rows else b.slice(0, 1) for b in batches), df.schema)
    assert sizes.count() == 1 and df.count() == 360


def test_errors(spark):
    with pytest.raises(SignalError, match="unsupported file type"):
        recording.read_recording(spark, "a.doc")
    with pytest.raises(SignalError, match="file not found"):
        recording.read_recording(spark, "/nowhere/a.csv")
    with pytest.raises(SignalError, match="cannot be determined"):
        recording.parse([["a", "b"], ["1", "2"]])
    with pytest.raises(SignalError, match="not detected"):
        recording.parse([["a", "b"], ["1", "2"]], "c")


def test_formats():
    assert timefmt.format_hmmss([3661.25]) == ["1:01:01.25"] and timefmt.format_hmmss([-30.0]) == ["-00:30"]
    assert timefmt.format_hmmss([90.5, None]) == ["01:30.50", None]
    assert timefmt.breaks_timespan(0, 100) == [0, 20, 40, 60, 80, 100]
    assert [snapped(r) for r in (44, 11, 9.5, 0.8)] == [50, 10, 10, 1]
    assert len(set(palette.palette(20))) == 20 and palette.palette(["red"]) == [palette.PALETTE["red"]]
    with pytest.raises(SignalError):
        palette.palette(["mauve"])


def test_roles_survive_parquet(spark, tmp_path):
    from oxyframe.frame import SignalFrame

    from .helpers import vector

    vector(spark, [1.0, 2.0]).with_meta(sample_rate=2.0).write(str(tmp_path / "p"))
    back = SignalFrame.read(spark, str(tmp_path / "p"))
    assert back.meta.channels == ("x",) and back.meta.time_channel == "t" and back.meta.sample_rate == 2.0
