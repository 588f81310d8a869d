"""JavaScript / TypeScript module templates for the code corpus (own code).

(extension, source) pairs; ``{SECRET}`` only ever appears inside a string.
"""

JS_TEMPLATES: tuple[tuple[str, str], ...] = (
    # 0: SQL through template and variable, exec with child_process, fs path
    (".js", """const cp = require('child_process');
const fs = require('fs');

function listOrders(db, user) {
  db.query(`SELECT * FROM orders WHERE user = '${user}'`);
  const q = "SELECT * FROM t WHERE id = " + user;
  db.execute(q);
  cp.exec("ls " + user);
  fs.readFileSync(user + '.txt');
  db.query("SELECT 1");
}
"""),
    # 1: secrets, weak random token, weak hash, innerHTML
    (".js", """const crypto = require('crypto');
const API_KEY = "{SECRET}";
let password = "abc";

function render(el, html) {
  const resetToken = Math.random().toString(36).slice(2);
  const digest = crypto.createHash('MD5').update(html).digest('hex');
  el.innerHTML = html;
  el.innerHTML = "<b>static</b>";
  return digest + resetToken;
}
"""),
    # 2: CORS header and options, JWT none, cookies, eval / new Function
    (".js", """const jwt = require('jsonwebtoken');

app.use(cors({ origin: '*' }));
app.get('/x', (req, res) => {
  res.setHeader('Access-Control-Allow-Origin', '*');
  res.cookie('sid', req.id);
  res.cookie('a', 'b', { secure: true, httpOnly: true });
  res.cookie('c', 'd', { secure: true });
  jwt.verify(req.token, key, { algorithms: ['none', 'HS256'], algorithm: 'NONE' });
  eval(req.body.code);
  eval("1 + 1");
  const f = new Function("a", "return a");
  return f;
});
"""),
    # 3: one-hop taint into an arrow function (note), static caller silent
    (".js", """const runSql = (db, stmt) => {
  db.query(stmt);
};

function search(db, term) {
  runSql(db, "SELECT * FROM items WHERE name = '" + term + "'");
}

function fixed(db) {
  runSql(db, "SELECT 1");
}
"""),
    # 4: alias, kill by reassignment, declarator without value kills
    (".js", """function load(db, id) {
  let base = `SELECT * FROM a WHERE id = ${id}`;
  let copy = base;
  db.query(copy);
  copy = "SELECT 2";
  db.query(copy);
  let other = base;
  let other2;
  other = other2;
  db.query(other);
}
"""),
    # 5: methods, class field arrows and seeding by name, two hops silent
    (".js", """class Repo {
  find(stmt) {
    this.db.query(stmt);
  }
  remove = (path) => {
    fs.unlinkSync(path);
  };
}

function find(stmt) {
  return stmt;
}

function middle(stmt) {
  find(stmt);
}

function top(user) {
  middle("DELETE " + user);
  remove("/tmp/" + user);
}

function remove(path) {
  return path;
}
"""),
    # 6: safe look-alikes (no findings)
    (".js", """const crypto = require('crypto');

function safe(db, re, id, res) {
  db.query("SELECT * FROM t WHERE id = ?", [id]);
  re.exec("abc");
  require('child_process').exec("ls");
  crypto.createHash('sha256');
  res.setHeader('Access-Control-Allow-Origin', 'https://example.com');
  res.cookie('s', 'v', { secure: true, httpOnly: true, sameSite: 'strict' });
  const token = crypto.randomBytes(16).toString('hex');
  const { secretKey } = process.env;
  let password = process.env.PW;
  return token + secretKey + password;
}
"""),
    # 7: TypeScript: typed parameters, interface, generics, access modifiers
    (".ts", """import { createHash } from 'crypto';

interface User { id: number; name: string }
type Maybe<T> = T | null;

export class UserService {
  private readonly secretToken: string = "{SECRET}";

  constructor(private db: Db) {}

  async byName(name: string, limit?: number): Promise<User[]> {
    const sql: string = `SELECT * FROM users WHERE name = '${name}' LIMIT ${limit}`;
    return this.db.raw(sql) as User[];
  }
}

export function hash<T>(input: T): string {
  return crypto.createHash("sha1").update(String(input)).digest("hex");
}
"""),
    # 8: exec as a bare function (destructured import), fs writes, comments as arguments
    (".js", """const { exec, execSync } = require('child_process');

export default function (req) {
  exec(`tar czf ${req.file}`);
  execSync("rm -rf " + req.dir);
  fs.writeFile(/* target */ req.path + '.bak', 'x', () => {});
  fs.writeFile(req.path + '.log', 'x', () => {});
}
"""),
    # 9: syntax error -> parse error row, no findings
    (".js", """function broken( {
  return 1;
}
"""),
    # 10: seeded file dedupes same-line findings; object-method scope names
    (".js", """const api = {
  run(db, stmt) {
    db.query(stmt);
  },
};

function send(db, stmt) {
  db.query(stmt); db.query(stmt);
}

function caller(db, v) {
  send(db, "SELECT " + v);
  const h1 = crypto.createHash('md5'), h2 = crypto.createHash('sha1');
}
"""),
    # 11: module level, assignment-named function expressions, regex literals
    (".js", """const cp = require('child_process');
module.exports.handler = function (event) {
  cp.execFileSync(event.cmd + " --fast");
  const ok = /^[a-z]+$/.test(event.name);
  return ok;
};
let auth_token = 'tok-' + Date.now();
var PRIVATE_KEY = '{SECRET}';
document.body.innerHTML = `<p>${auth_token}</p>`;
"""),
    # 12: JSX with an apostrophe in its text; a sink beside it and one inside an attribute
    (".jsx", """import React from 'react';

const View = ({ rows, html }) => (
  <div className="list">
    don't panic: {rows.map(r => <li key={r.id}>{r.name}</li>)}
  </div>
);

export function Search(db, term) {
  db.query("SELECT * FROM t WHERE n = '" + term + "'");
  return <p onClick={() => document.body.innerHTML = term}>it's fine</p>;
}
"""),
    # 13: nested generics, destructured parameters, old casts, import types, quotes in a regular expression
    (".tsx", """type Loader = typeof import('./loader');

export async function load(m: Map<string, Array<number>>, { a, b }: Opts, [c] = [], ...rest: string[]): Promise<Map<string, number>> {
  const y = <string>pick("a" + b);
  if (/["'`]/.test(y)) { cp.exec(`ls ${y}`); }
  return m;
}

class Box<T> extends Base<T> {
  static async save<U>(path: string): Promise<void> { fs.writeFileSync(path + '.json', '{}'); }
}
"""),
    # 14: first line for the shell; a named function expression is called by its declarator's name, its scope has its own
    (".js", """#!/usr/bin/env node
const run = function inner(db, stmt) {
  db.query(stmt);
};
function outer(db, v) {
  run(db, "SELECT " + v);
  inner(db, "DELETE " + v);
}
const strip = s => s.replace(/['"]/g, '');
"""),
    # 15: sinks inside template substitutions, nested templates, template text that looks like code
    (".js", """const cp = require('child_process');

function page(db, items, u) {
  const x = `a ${eval(u)} b`;
  const list = `<ul>${items.map(i => {
    document.body.innerHTML = i;
    return eval(i);
  })}</ul>`;
  const deep = `1 ${`2 ${cp.exec('ls ' + u)} '3`} "4`;
  db.query(`SELECT ${`'${u}'`} FROM t`);
  return `plain {$u} )( \\${eval(u)}` + x + list + deep;
}

function after(a) { return a; }
"""),
    # 16: JSX: apostrophes and quotes in text and attributes, sinks beside and inside, fragments, no secrets in attributes
    (".jsx", """import cp from 'child_process';

export const List = ({ rows, html }) => (
  <section title="it's" onClick={() => eval(html)}>
    <p>don't</p> {rows.map(r => <li key={r.id}>isn't {eval(r.name)}</li>)}
    <Input password="abcdef" secret='0123456789' />
    <>can't</>
  </section>
);

function Note({ text }) {
  cp.exec('ls ' + text); return <b>it's {text} / {text}</b>;
}

export function Last(db, v) { const a = <p>won't</p>; db.query("SELECT " + v); return a / 2; }
"""),
)
