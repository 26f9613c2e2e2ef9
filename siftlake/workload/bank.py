"""Code lines and path parts from which the derived corpus is put together.

For each rule there is a line it matches and, where it helps, a near miss; the
rest are comment marks, definitions and blanks."""

BANK = [
    # secrets and near misses
    'password = "hunter2"', "pass='x'", 'db_pwd = "p"', 'api_key = "abc1"', "apikey='abcd'",
    'secret = "s3"', 'token = "abcdef"', 'token = "abc"', 'key = "Ab9"', 'key = "A9"',
    'x = "ABCDEFGHIJKLMNOP"', "y = 'ABCDEFGHIJKLMN+/QRSTUV=='", 'password = ""', "password = get()",
    # injection and commands
    "result = eval(data)", "exec (code)", "os.system(cmd)", "p = subprocess.run(a)",
    "mod = __import__(name)", 'q = "SELECT a FROM t" + w', 'q = "INSERT INTO t" + v',
    "q = 'UPDATE t SET a=' + v", "q = 'DELETE FROM t' + w", 'cur.execute("x %s" % v)',
    "query = base + tail", 'q = "SELECT a FROM t"', "medieval(castle)", "posxsystem(cmd)",
    # web
    "node.innerHTML = text", "document.write(text)", "location.href = target", "window.open(target)",
    "documentXwrite(text)",
    # files
    "f = open(base + name)", "f = file(base + name)", "p = '../up'", "p = '/etc/hosts'",
    "p = 'C:\\\\Windows'", "p = 'C:\\Windows'",
    # hashing, transport, serialisation
    "h = md5(a)", "h = sha1(a)", "get(u, verify=False)", "get(u, ssl_verify = False)",
    "u = 'http://a.b'", "u = 'ftp://a.b'", "telnet host", "pickle.dumps(a)", "yaml.load(a)",
    "json.loads(input)", "u = 'https://a.b'", "yaml_load(a)",
    # accounts, randomness, debug
    "admin = 'u123'", "root_password()", "if who == 'admin':", "random.random()",
    "time() and seed(1)", "DEBUG = True", "run(1)  # TODO security", "x = 'FIXME security'",
    "print(password)", "console.log(password)", "TODO: security later", "DEBUG = 0",
    # advanced
    "cur.execute(sql)", "shell.system (cmd)", "v = input('n')", "request.args", "session['a']",
    "cookie['a']", "a.hash(b)", "a.encrypt(b)", "a.decrypt(b)", "root = 1", "sudo reboot",
    "chmod 777 f", "db.connect()", "inputs", "requests",
    # quality
    "except: pass", "except Exception: pass", "except ValueError: continue", "if True:",
    "if False:", "while True: step()", "while True: break", "return None", "if len(a) == 0:",
    "def makeThing(self):", "class lower:", "MaxSize = 10", "console.debug(a)", "print('debug a')",
    "debugger;", "alert(a)", "HACK: look", "BUG: broken", "for i in range(len(a)):",
    "a += [1, 2]", "code = 404", "code = 404  # fine", "time.sleep(30)", "sleep(n)", "global state",
    "eval(input(a) or eval(b))", "import\t*", "from\tmod\timport\t*", "from mod import *",
    "import os, sys", "# from here on", "from ... import deep", "x = 1; import os",
    # performance
    "for a in b: for c in d: for e in f:", "s += 'tail'", "str + str", "[x.append(y) for y in z]",
    "list(filter(f, a))", "t = open(p).read()", "a = f.readlines()", "for r in query(a): go()",
    "c.execute(s) for s in many", "a = b * []", "b = deepcopy(a)", "re.match(p, s)",
    "time.sleep(5)",
    # maintainability
    "a if b else c if d else e if f else g", "if a: if b: if c: if d: e()",
    "f = lambda a: lambda b: a", "if a == 42:", "if a > 42:", "if a < 42:", "if a == 4:",
    "go()  # old = new", "go();  // old = new", "p = 'D:\\data'", "p = '/home/me'",
    "class Widget(Base):", "class Undone:",
    # best practice
    "except:", "except Exception:", "print(a)", "def collect(a, b=[]):", "def settings(a={}):",
    "def plain(a):", "async def later(a):", "pass", "raise Exception('a')", "if a == True:",
    "if a == False:", "if a == None:", "if a != None:", "'%s' % (a)", "'{}'.format(a)",
    "assert a, 'm'", "bypass  ", "def typed(a) -> int:",
    # comments and documentation
    '"""', "'''", '"""one line"""', "'''one line'''", '    """Opens a text', "x = 1  '''", "/*",
    "*/", "/* both */", "end */ tail()", "/** text", " * star line", "// slash line", "# TODO later",
    "// fixme soon", "    # hash line", "    fixme_todo()",
    # blanks and white space
    "", "   ", "\t", "\xa0\xa0x\xa0= 1", "\tx\t=\t2", "  trailing  ", "caf\xe9 = 'cr\xe8me'",
    "value = compute(a)", "return value", "end", "}",
    # numbers, and letters that fold to ASCII ones
    "go(404)", "go(404)  # fine", "go(1000) # 100", "while True: a()  # break",
    "\u017fubprocess.call(a)", "if a > 42: return 100", "BUGS: none", "bitbucket.clone(a)",
]

DIRS = ["", "src/", "tests/", "src/core/", ".github/", "node_modules/lib/", "build/",
        "pkg/__pycache__/", "src/.hidden/", "venv/", "docs/", "demo_app/", "lib/util/"]
EXTENSIONS = [".py", ".js", ".py", ".java", ".rb", ".go", ".py", ".php", ".cs", ".json", ".txt",
              ".py", ".ts", ".c", ".yml", ".tsx", ".py"]
STEMS = ["mod_", "my file ", "m\xf3dulo", "test_", ".hidden", "example_", "Util"]
