"""Credentials as env files hold them."""

from outlinelake.llm.secrets import scan_secrets


def test_env_file_lines(spark):
    key, secret = "AKIA" + "A1" * 8, "aB3/" * 10
    text = f"AWS_ACCESS_KEY_ID={key}\nAWS_SECRET_ACCESS_KEY={secret}\nURL=https://a.example\n"
    docs = spark.createDataFrame([(1, text), (2, text.replace(key, "none"))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in scan_secrets(docs).collect()}
    at = text.index(secret)
    assert f"secret:{at}:{at + 40}" in got[1]["spans"].split(",") and "endpoint" in got[1]["spans"] and got[1]["n_linked"] == 2
    assert got[2]["n_linked"] == 0
