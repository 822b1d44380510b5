"""The test tables read as kernel events, the registered queries over them, and their SQL oracles."""
