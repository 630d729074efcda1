"""tessitura: a PySpark-native engine for speech-corpus, speaker and text data.

The library is a set of DataFrame operators. ``functions`` holds column
expressions, ``operators`` the relational operators built from them,
``sources`` the readers and writers, ``plans`` the registered queries with
their equivalent SQL, and ``streaming`` the incremental variants.
"""
