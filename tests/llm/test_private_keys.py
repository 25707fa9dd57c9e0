"""Private keys leave the text whole."""

import base64
import random

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def lines(seed):
    body = base64.b64encode(random.Random(seed).randbytes(400)).decode()
    return [body[i : i + 64] for i in range(0, len(body), 64)]


def test_private_keys(spark):
    from lodeseek.llm.secrets import redacted, secret_spans

    key, head, end = lines(1), "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    fields = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00112233445566778899AABBCCDDEEFF\n\n"
    forms = [
        "\n".join([head, *key, end]), "\r\n".join([head, *key, end]), "\\n".join([head, *key, end]), " ".join([head, *key, end]), "\n    ".join([head, *key, end]),
        head + "\n" + fields + "\n".join([*key, end]), "\n".join([head, *key]), head + "\n" + fields + "\n".join(key), "\\n".join([head, *key]),
    ]
    rows = [(i, f"é before {t}. After - text", "en", "s", 0) for i, t in enumerate(forms)]
    rows += [(90, "\n".join([*forms[:1], "between", forms[6], "", forms[0]]), "en", "s", 0), (91, head + " x", "en", "s", 0), (92, head + "\nis how keys begin", "en", "s", 0)]
    frame = spark.createDataFrame(rows, TEXT)
    got = {r["doc_id"]: r["text"] for r in redacted(frame).collect()}
    for i in range(len(forms)):
        assert got[i] == "é before <private_key>. After - text"
    assert not any(k[:12] in got[90] for k in key) and "between" in got[90]
    assert got[91] == "<private_key> x" and got[92] == "<private_key>\nis how keys begin"
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "private_key"] for r in secret_spans(frame).collect()}
    assert all(spans[i] == [(9, 9 + len(t))] for i, t in enumerate(forms)) and len(spans[90]) == 3
