"""Python module templates for the code corpus derived from ``documents``.

Each template is a small module of our own exercising detectors, safe
look-alikes and taint cases.  ``{SECRET}`` is replaced by the md5 of the
document's text.  Templates stay placeholder-safe: the placeholder only ever
appears inside a string literal, so the AST does not change with the value.
"""

PY_TEMPLATES: tuple[str, ...] = (
    # 0: SQL built inline and through a variable; kill by re-assignment
    '''import sqlite3


def find_user(conn, name):
    cur = conn.cursor()
    cur.execute(f"SELECT * FROM users WHERE name = '{name}'")
    return cur.fetchall()


def find_by_id(conn, uid):
    query = "SELECT * FROM users WHERE id = " + str(uid)
    conn.cursor().executemany(query, [])
    query = "SELECT 1"
    conn.execute(query)
''',
    # 1: subprocess with shell=True, os.system with a variable, safe list form
    '''import os
import subprocess


def run_tool(arg):
    subprocess.run("tool " + arg, shell=True)
    subprocess.check_output(["tool", arg])
    os.system(arg)
    os.system("ls -la")
    subprocess.Popen(arg, shell=False)
''',
    # 2: hard-coded secrets (redacted), short placeholder skipped, random token
    '''import random

API_KEY = "{SECRET}"
password = ""
db_passwd = "pw"


class Settings:
    auth_token = "{SECRET}-tail"

    def reset(self):
        session_token = random.randint(0, 10 ** 6)
        return session_token
''',
    # 3: pickle, yaml with and without a safe loader, eval/exec
    '''import pickle
import yaml


def load_blob(data, text, expr):
    obj = pickle.loads(data)
    cfg = yaml.load(text)
    ok = yaml.load(text, Loader=yaml.SafeLoader)
    bad = yaml.load(text, Loader=yaml.UnsafeLoader)
    value = eval(expr)
    exec("print(1)")
    return obj, cfg, ok, bad, value
''',
    # 4: weak hashes, debug mode, TLS off, cookies
    '''import hashlib
import requests
from flask import Flask, make_response

app = Flask(__name__)


def digest(data):
    a = hashlib.md5(data).hexdigest()
    b = hashlib.sha1(data).hexdigest()
    c = hashlib.sha256(data).hexdigest()
    return a, b, c


def fetch(url):
    r = requests.get(url, verify=False)
    s = requests.post(url, verify=True)
    resp = make_response("ok")
    resp.set_cookie("sid", "x", secure=True, httponly=True)
    resp.set_cookie("pref", "y")
    return r, s, resp


if __name__ == "__main__":
    app.run(debug=True)
''',
    # 5: path traversal through open() inline and through a variable
    '''import os


def read_report(base, name):
    path = os.path.join(base, name)
    with open(path) as fh:
        first = fh.read()
    target = base + "/" + name
    with open(target) as fh:
        second = fh.read()
    with open("%s/%s" % (base, name)) as fh:
        third = fh.read()
    return first, second, third
''',
    # 6: one-hop cross-function taint (note on the sink), static caller silent
    '''def run_query(cursor, sql):
    cursor.execute(sql)


def lookup(cursor, name):
    run_query(cursor, "SELECT * FROM t WHERE n = '%s'" % name)


def fixed(cursor):
    run_query(cursor, "SELECT 1")
''',
    # 7: alias chain inside a function, multi-target alias fall-through
    '''def report(cursor, day):
    base = "SELECT * FROM log WHERE day = " + day
    q1 = base
    q2 = q1
    cursor.execute(q2)
    clean = "SELECT 1"
    x = y = clean
    cursor.execute(x)
    z = base
    z = w = clean
    cursor.execute(z)
''',
    # 8: assignment takes effect before calls on its right-hand side
    '''def refresh(cursor, table):
    q = "SELECT * FROM " + table
    q = cursor.execute(q)
    cursor.execute(q)
    r = "DELETE FROM " + table
    cursor.execute(r)
''',
    # 9: two hops must not fire; seeded method of the same name is seeded too
    '''def level_two(cur, stmt):
    cur.execute(stmt)


def level_one(cur, stmt):
    level_two(cur, stmt)


def entry(cur, user):
    level_one(cur, "SELECT " + user)


class Repo:
    def level_one(self, stmt):
        self.cur.execute(stmt)
''',
    # 10: arity mismatch, keyword-only parameter, star-args call
    '''def writer(path):
    with open(path, "w") as fh:
        fh.write("x")


def caller(a, b):
    writer("out/" + a, "extra/" + b)
    writer(*[a])


def only_kw(*, path):
    return open(path)


only_kw(path="a" + "b")
''',
    # 11: seeded file dedupes same-line findings; unseeded twin below keeps both
    '''import hashlib


def sink(cur, stmt):
    cur.execute(stmt)


def source(cur, v):
    sink(cur, "SELECT " + v)
    h = hashlib.md5(b"a"); g = hashlib.md5(b"b")
    return h, g
''',
    # 12: unseeded file: two findings of one rule on one line both stay
    '''import hashlib


def digests():
    h = hashlib.md5(b"a"); g = hashlib.md5(b"b")
    token = "{SECRET}"; secret_key = "{SECRET}"
    return h, g, token, secret_key
''',
    # 13: scopes - module taint invisible in functions, class body shares module scope
    '''stmt = "SELECT " + input()


def use_module_var(cur):
    cur.execute(stmt)


class Holder:
    query = "SELECT " + input()
    cur.execute(query)


cur.execute(stmt)
''',
    # 14: nested functions open a scope; lambda does not
    '''def outer(cur, v):
    q = "SELECT " + v

    def inner():
        cur.execute(q)

    run = lambda: cur.execute(q)
    inner()
    return run
''',
    # 15: decorators and defaults are visited inside the function
    '''import subprocess


def deco(x):
    return x


@deco(subprocess.call("id", shell=True))
def handler(cmd=subprocess.run("echo", shell=True)):
    return cmd
''',
    # 16: safe look-alikes (no findings)
    '''import json
import secrets
import hmac


class Store:
    def eval(self, x):
        return x


def safe(cur, conn, name, data):
    cur.execute("SELECT * FROM t WHERE n = ?", (name,))
    obj = json.loads(data)
    Store().eval(name)
    token = secrets.token_hex(16)
    sig = hmac.new(b"k", data, "sha256").hexdigest()
    conn.run(debug=False)
    return obj, token, sig
''',
    # 17: syntax error -> parse error row, no findings
    '''def broken(:
    pass
''',
    # 18: random token forms and secret names with Unicode case folding
    '''from random import choice, randint
import random


def make():
    reset_token = choice("abc")
    API_SECRET_VALUE = random.random()
    counter = randint(0, 9)
    KEY_TOKEN = "plain"
    return reset_token, API_SECRET_VALUE, counter
''',
    # 19: async functions, methods, nested classes for the file inventory
    '''class Service:
    async def fetch(self, url, timeout=3):
        return url

    def close(self):
        return None

    class Inner:
        def hidden(self):
            return 1


async def main(argv, *rest, flag=False, **kw):
    def helper(y):
        return y
    return helper(argv)
''',
    # 20: two sinks reached only through a seed; alias of a seeded parameter
    '''def store(cur, value):
    copy = value
    cur.executescript(copy)
    with open(value) as fh:
        return fh.read()


def handler(cur, req):
    store(cur, "INSERT " + req)
''',
    # 21: format() and % on numbers count as dynamic; redefinition: last def wins
    '''def total(cur, n):
    cur.execute("{} items".format(n))
    cur.execute(n % 2)


def target(cur, a):
    return a


def target(cur, a, b):
    cur.execute(b)


def call_it(cur, x):
    target(cur, "x", "DROP " + x)
''',
    # 22: kill by single target, tuple target does nothing, sanitiser kills
    '''def clean(cur, v):
    q = "SELECT " + v
    q = sanitize(q)
    cur.execute(q)
    p = "SELECT " + v
    p, other = "SELECT 1", 2
    cur.execute(p)
''',
    # 23: module-level code only (no function names)
    '''import os
import pickle

data = pickle.load(open("cache.bin", "rb"))
os.popen("uptime " + os.environ.get("X", ""))
PRIVATE_KEY = "{SECRET}"
''',
    # 24: an integer too long to print in decimal does not stop the file
    "BIG = 0x" + "f" * 5000 + """

def run(cur, v):
    cur.execute("SELECT " + v)
""",
    # 25: taint through an alias chain of 1,000 steps
    "def chain(cur, v):\n    q0 = 'SELECT ' + v\n" + "".join(f"    q{i} = q{i - 1}\n" for i in range(1, 1001)) + "    cur.execute(q1000)\n",
)
