"""boxmeter.streaming"""
