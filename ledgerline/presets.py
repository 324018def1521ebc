"""A small demonstration database, and statements to try on it, by topic."""

from __future__ import annotations

from .database import Database

#: Statements that make the tables `users` and `posts` and fill them.
SEED = (
    "CREATE TABLE users (id INTEGER PRIMARY KEY AUTOINCREMENT, handle TEXT NOT NULL UNIQUE, city TEXT, staff BOOLEAN DEFAULT FALSE, CHECK (handle LIKE '_%'))",
    "CREATE TABLE posts (id INTEGER PRIMARY KEY AUTOINCREMENT, author INTEGER REFERENCES users(id) ON DELETE CASCADE ON UPDATE CASCADE, subject TEXT NOT NULL, likes INTEGER DEFAULT 0)",
    *(f"INSERT INTO users (handle, city, staff) VALUES ({v})" for v in ("'mira', 'Lisbon', TRUE", "'tomas', 'Brno', FALSE", "'yuki', NULL, FALSE")),
    "INSERT INTO users (handle) VALUES ('guest')",
    *(f"INSERT INTO posts (author, subject, likes) VALUES ({v})" for v in ("1, 'Tide tables', 14", "1, 'Harbour lights', 3", "2, 'A short walk', 27", "3, 'Paper cranes', 8")),
    "INSERT INTO posts (subject) VALUES ('Nobody wrote this')",
)
#: Topic, title, statements.
PRESETS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("tables", "Every table", ("SHOW TABLES",)),
    ("tables", "Columns of a table", ("DESCRIBE users",)),
    ("tables", "The statement that makes a table", ("SHOW CREATE TABLE posts",)),
    ("reading", "A pattern with one free end", ("SELECT handle FROM users WHERE handle LIKE 'm%'",)),
    ("reading", "Unknown is not false", ("SELECT handle FROM users WHERE city != 'Brno' OR city IS NULL",)),
    ("reading", "Posts with their authors", ("SELECT posts.subject, users.handle FROM posts JOIN users ON posts.author = users.id ORDER BY likes DESC",)),
    ("reading", "The second page", ("SELECT subject, likes FROM posts ORDER BY likes DESC LIMIT 2 OFFSET 2",)),
    ("changes", "One row more, with defaults", ("INSERT INTO users (handle) VALUES ('noor')",)),
    ("changes", "A key that takes its children along", ("UPDATE users SET id = 70 WHERE handle = 'tomas'",)),
    ("changes", "A deletion that cascades", ("DELETE FROM users WHERE handle = 'mira'",)),
    ("rules", "A second handle of that name", ("INSERT INTO users (handle) VALUES ('yuki')",)),
    ("rules", "A check that fails", ("INSERT INTO users (handle) VALUES ('')",)),
    ("scans", "The pattern behind a scan", ("EXPLAIN REGEX SELECT subject FROM posts WHERE likes != 0",)),
)


def seeded(spark, limits=None) -> Database:
    """A database with the demonstration's tables and rows."""
    db = Database(spark, limits)
    for s in SEED:
        db.execute(s)
    return db
