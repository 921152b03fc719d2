"""Credentials of object stores as Hadoop settings: explicit, a named profile, or the environment."""

from __future__ import annotations

import configparser
import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Names of the settings that hold each credential.
S3 = {"access_key": "fs.s3a.access.key", "secret_key": "fs.s3a.secret.key", "session_token": "fs.s3a.session.token", "region": "fs.s3a.endpoint.region", "endpoint": "fs.s3a.endpoint"}
#: The endpoint at which Google's store speaks S3, for HMAC keys.
GS_ENDPOINT = "https://storage.googleapis.com"
#: Reads the token that ``gs_conf`` puts into the session.
TOKENS = "fs.gs.auth.access.token"


def profile(name: str) -> dict[str, str]:
    """The entries of a profile in the credentials file."""
    found = configparser.ConfigParser()
    found.read(os.environ.get("AWS_SHARED_CREDENTIALS_FILE", Path.home() / ".aws/credentials"))
    if name not in found:
        raise KeyError(f"no such profile: {name}")
    return dict(found[name])


def resolved(auth: dict | str | None, in_profile: dict[str, str], in_env: dict[str, str]) -> dict[str, str]:
    """Credentials by their own names, from a record, a profile's name or, for none, the environment."""
    if isinstance(auth, str):
        entries = profile(auth)
        return {k: entries[v] for k, v in in_profile.items() if entries.get(v)}
    return {k: v for k, v in (auth or {k: os.environ.get(v) for k, v in in_env.items()}).items() if v}


def s3_conf(auth: dict | str | None = None) -> dict[str, str]:
    keys = resolved(
        auth,
        {"access_key": "aws_access_key_id", "secret_key": "aws_secret_access_key", "session_token": "aws_session_token", "region": "region"},
        {"access_key": "AWS_ACCESS_KEY_ID", "secret_key": "AWS_SECRET_ACCESS_KEY", "session_token": "AWS_SESSION_TOKEN", "region": "AWS_REGION"},
    )
    return {S3[k]: v for k, v in keys.items() if k in S3}


def gs_conf(auth: dict | str | None = None) -> dict[str, str]:
    """A key file, a bearer ``token`` (put into the session for the token provider that the cluster's connector is given), or an HMAC pair, whose buckets are then read as ``s3://``."""
    keys = resolved(
        auth,
        {"access_key": "gs_access_key_id", "secret_key": "gs_secret_access_key", "token": "gs_token", "key_file": "gs_key_file"},
        {"key_file": "GOOGLE_APPLICATION_CREDENTIALS", "token": "GCS_ACCESS_TOKEN", "access_key": "GCS_ACCESS_KEY_ID", "secret_key": "GCS_SECRET_ACCESS_KEY"},
    )
    if keys.get("key_file"):
        return {"fs.gs.auth.type": "SERVICE_ACCOUNT_JSON_KEYFILE", "fs.gs.auth.service.account.json.keyfile": keys["key_file"]}
    if keys.get("token"):
        return {"fs.gs.auth.type": "ACCESS_TOKEN_PROVIDER", TOKENS: keys["token"]}
    if keys.get("access_key") and keys.get("secret_key"):
        return s3_conf({"access_key": keys["access_key"], "secret_key": keys["secret_key"], "endpoint": GS_ENDPOINT})
    return {}


def azure_conf(auth: dict | str | None = None) -> dict[str, str]:
    keys = resolved(auth, {"account": "azure_storage_account", "key": "azure_storage_key"}, {"account": "AZURE_STORAGE_ACCOUNT", "key": "AZURE_STORAGE_KEY"})
    return {f"fs.azure.account.key.{keys['account']}.dfs.core.windows.net": keys["key"]} if keys.get("account") and keys.get("key") else {}


def use(spark: SparkSession, conf: dict[str, str]) -> None:
    """Sets them for the session's file systems."""
    for k, v in conf.items():
        spark.conf.set(k, v)
