"""Private keys are masked whole."""

import base64
import random

import pytest

from tabscore.llm import secrets

KEY = base64.b64encode(random.Random(3).randbytes(610)).decode()
LINES = [KEY[i : i + 64] for i in range(0, len(KEY), 64)]
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
HEADERS = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00FF", ""]


@pytest.mark.parametrize(
    "block",
    [
        "\n".join([BEGIN, *LINES, END]),
        "\r\n".join([BEGIN, *HEADERS, *LINES, END]),
        "\\n".join([BEGIN, *LINES, END]),
        "\n".join([BEGIN, *LINES]),
        "\n".join([BEGIN, *HEADERS, *LINES]),
        " ".join([BEGIN, *LINES, END]),
        "\n".join([BEGIN, *LINES, BEGIN, *LINES, END]),
        "\n".join([BEGIN, *LINES * 3_000, END]),
        "\n".join([BEGIN, *[KEY[i : i + 12] for i in range(0, len(KEY), 12)]]),
    ],
)
def test_no_line_of_a_private_key_stays(spark, block):
    text = f"Words before.\n{block}\nWords after the key stay - all of them."
    got = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert not any(line in got for line in [*LINES, KEY[:12], KEY[-20:]]) and "PRIVATE" not in got
    assert got.startswith("Words before.\n[SECRET]") and got.endswith("\nWords after the key stay - all of them.")


def test_a_header_alone_takes_no_words(spark):
    text = f"Keys begin with {BEGIN} and so on, {BEGIN}\nSome words - then more."
    got = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert got == "Keys begin with [SECRET] and so on, [SECRET]\nSome words - then more."
