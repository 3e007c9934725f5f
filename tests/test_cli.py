"""Building a tariff and classifying from the command line."""

import json

from stratalex.__main__ import main
from stratalex.plans import build

SCHEDULE = """
CHAPTER 27
MINERAL FUELS
27.10          Petroleum oils:
2710.12.00   7 - Light spirit  kg  5%
2710.19.30   1 - Oil for crankcases  li  10%  free
CHAPTER 32
PUTTY
32.14          Mastics
3214.10.00   3 - Painters' fillings kg free
"""


def read(path, content):
    return content.decode(), [], None


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "s.txt").write_text(SCHEDULE)
    tariff = str(tmp_path / "tariff")
    assert main(["--tariff", tariff, "--rebuild", str(tmp_path / "s.txt"), "--source_date", "2026-08-28", "--describe", "Crankcase oils", "--quantity", "4"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got[0]["hs_code"] == "2710.19.30" and got[0]["quantity"] == 4 and got[0]["duty_rate_general"] == "10%"
    corpus = build.load(spark, tariff)
    assert corpus.leaf_count == 3 and corpus.date == "28 August 2026" and corpus.tariff.filter("chapter = '27'").count() == 3
    assert main(["--tariff", tariff, "--file_path", str(tmp_path / "none")], spark) == 2
    (tmp_path / "in").mkdir()
    assert main(["--tariff", tariff, "--file_path", str(tmp_path / "in")], spark) == 1
    (tmp_path / "one.docx").write_bytes(b"?")
    assert main(["--tariff", tariff, "--file_path", str(tmp_path / "one.docx")], spark) == 1
