"""boxmeter.llm"""
